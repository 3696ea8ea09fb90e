"""Surrogates for personal data, in DataFrame functions alone.

One pattern finds e-mail addresses, secrets, links with a user name, IPv4 and IPv6 and MAC addresses, IBANs, card and
phone numbers, social security numbers, birth dates after a cue, and names after a title. Each entity gets a surrogate
made from a keyed hash of its type and normal form, so one entity has one surrogate wherever it stands, in whatever
spelling of spaces and capitals. A surrogate keeps type and format: digits for digits, card numbers with a right check
digit and the length, phones with their punctuation, given names of the same gender and script, capitals as they were.

A name is two entities, given and family name, so Mr. John Smith and Mr. Smith share the surname's surrogate. Capitals
don't tell names apart.

Collisions: the entities' surrogates are gathered; where two entities share one, or a surrogate is an entity of the
data, all but the first take the next attempt of the hash, until none is left. Each attempt draws from a larger space:
more syllables and given names, more years and octets. From attempt LAST on, the surrogate gets a tail of 64 keyed bits,
so attempts end whatever number of entities share a format. Attempts join back to the documents that
hold entities; documents without are not shuffled.

A secret has a letter or digit: a masked one (password: ****) is none. Letters without case become small Latin letters.
Beyond LONGEST characters a secret's digits and letters become one digit and one letter of their class.

The key comes from the setting turnstone.pii.key; without it, the public default KEY is used, which anyone can repeat.

Null texts stay null, empty ones empty. Repeated rows get the same surrogates. Rows keep all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.llm.common import drop, stage

KEY = "turnstone"
#: The attempt from which surrogates get a tail, and the one that is never reached but by a broken hash.
LAST, NEVER = 6, 24
_WORD = r"(?<![\p{L}\p{N}])"
_END = r"(?![\p{L}\p{N}])"
#: Titles by gender, and given names by gender and script. Fixed values.
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "Sir", "Lord", "г-н", "Господин", "Κύριος")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Srta", "Doña", "Lady", "г-жа", "Госпожа", "Κυρία")
OPEN_TITLES = ("Dr", "Prof", "Mx", "Doctor", "Professor", "Д-р")
GIVEN = {
    ("male", "latin"): "Adam Bruno Carl David Edgar Felix Gustav Hugo Ivan Jonas Karl Leon Martin Noel Oscar Paul Quentin Robert Simon Thomas Ulrich Victor Walter Xavier Yves Zeno Albert Conrad Emil Frank Henry Julian",
    ("female", "latin"): "Alice Berta Clara Diana Elena Flora Greta Helen Irene Julia Karin Laura Maria Nora Olivia Paula Rita Sara Tina Ursula Vera Wilma Ximena Yvonne Zoe Anna Carmen Emma Frida Ines Lucia Martha",
    ("male", "cyrillic"): "Алексей Борис Виктор Григорий Дмитрий Евгений Иван Кирилл Лев Михаил Николай Олег Павел Роман Сергей Тимур",
    ("female", "cyrillic"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лидия Мария Нина Ольга Полина Раиса София",
    ("male", "greek"): "Ανδρέας Βασίλης Γιώργος Δημήτρης Ηλίας Θωμάς Ιάσων Κώστας Λουκάς Μάρκος Νίκος Ορέστης Παύλος Σπύρος Τάσος Φίλιππος",
    ("female", "greek"): "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Ηρώ Θάλεια Ιωάννα Κατερίνα Λυδία Μαρία Νεφέλη Ξένια Όλγα Σοφία",
}
#: Syllables of surnames, by script. Fixed values.
SYLLABLES = {"latin": "ba del for gan hol kir lam mon nor pel rin sen tal ver win zan", "cyrillic": "ба вол гор дан жен зим кор лап мор нов пет рож сол тур хар чер", "greek": "βα γερ δαν ζαρ θεο καλ λαμ μαν νικ παπ ριν σαρ τσι φωκ χατ ψαρ"}
#: Given names that tell a gender where a title doesn't. Fixed values.
KNOWN_MALE = "adam albert alexander andreas anton bruno carl carlos charles christian daniel david dmitri edward emil felix francis frank george hans heinrich henri henry hugo ivan jack jacques james jan jean john jonas jorge jose juan jules karl klaus leon louis lucas luis manuel marc mark martin max michael miguel nicolas oscar otto paul pedro peter philip pierre rafael richard robert samuel sergei simon stefan thomas victor walter william"
KNOWN_FEMALE = "alice amelie ana andrea anna barbara beatrice berta camille carla carmen caroline catherine charlotte christine clara claudia diana elena elisabeth elizabeth ella emily emma eva flora frida gabriela greta hannah helen helga ines ingrid irene isabel jane jeanne jennifer johanna julia karin katharina laura lena linda lisa louise lucia lucy maria marie marta martha mary monica nadia natalia nina nora olga olivia paula petra rosa sara sarah sofia sophie susan teresa ursula vera"

_TITLE = "|".join(sorted((t.replace("-", r"\-") for t in MALE_TITLES + FEMALE_TITLES + OPEN_TITLES), key=len, reverse=True))
#: What announces a secret.
_CUE = _WORD + r"(?i:(?:(?:api|access|secret|auth)[_ -]?)?(?:key|token|secret)|password|passwd|pwd|passphrase)[\"']?\s{0,3}[:=]\s{0,3}[\"']?"
#: The types in the order in which they are tried at each place.
PATTERNS = {
    "email": _WORD + r"[\p{L}\p{N}][\p{L}\p{N}._%+'-]{0,127}+@[\p{L}\p{N}][\p{L}\p{N}-]{0,62}(?:\.[\p{L}\p{N}][\p{L}\p{N}-]{0,62}){1,10}",
    "secret": rf"{_CUE}(?=[^\s\"',;\p{{L}}\p{{N}}]{{0,64}}[\p{{L}}\p{{N}}])[^\s\"',;]{{6,}}|{_WORD}(?:AKIA[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{30,}}|sk-[A-Za-z0-9]{{20,}}|eyJ[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]{{5,}})|{_WORD}(?=[0-9A-Fa-f]{{0,63}}[0-9])(?=[0-9A-Fa-f]{{0,63}}[A-Fa-f])[0-9A-Fa-f]{{32,64}}{_END}",
    "iban": _WORD + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _END,
    "mac": _WORD + r"(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}" + _END,
    "ipv6": r"(?<![\p{L}\p{N}:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}" + _END,
    "ip": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![\p{L}\p{N}]|\.[0-9])",
    "card": _WORD + r"(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})" + _END,
    "ssn": _WORD + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END,
    "phone": r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?\([0-9]{1,4}\)[ .-]?[0-9]{2,4}[ .-]?[0-9]{3,5}|\+[0-9]{1,3}(?:[ -]?[0-9]{2,4}){2,5}|\+[0-9]{1,3}(?:\.[0-9]{2,4}){2,5}|\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}|[0-9]{3}[-.][0-9]{3}[-.][0-9]{4})(?![\p{L}\p{N}]|\.[0-9])",
    "birth": r"(?i:(?<=born on )|(?<=born )|(?<=dob: )|(?<=date of birth: )|(?<=geboren am )|(?<=née? le )|(?<=nacid[oa] el ))(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4})" + _END,
    "name": _WORD + rf"(?:{_TITLE})\.? (?:\p{{Lu}}[\p{{L}}'’-]+ )?\p{{Lu}}[\p{{L}}'’-]+",
}
LONGEST = 180
ANY = "|".join(f"(?:{pattern})" for pattern in PATTERNS.values())
def _kind(entity: Column) -> Column:
    """The first type whose pattern is all of the entity. Look-behinds see nothing there, so cues don't count."""
    found = F.lit("birth")
    for kind, pattern in reversed(PATTERNS.items()):
        if kind != "birth":
            found = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(found)
    return found


def _normal(entity: Column, kind: Column) -> Column:
    """One spelling of an entity: lower case for addresses, digits alone for numbers, names without their title."""
    digits, bare = F.regexp_replace(entity, "[^0-9]", ""), F.upper(F.regexp_replace(entity, "[ :-]", ""))
    value = F.regexp_replace(entity, f"^{_CUE}", "")
    name = F.lower(F.regexp_replace(entity, rf"^(?:{_TITLE})\.? ", ""))
    return (
        F.when(kind.isin("email"), F.lower(entity)).when(kind.isin("phone", "card", "ssn"), digits)
        .when(kind.isin("iban", "mac", "ipv6"), bare).when(kind == "secret", value).when(kind == "name", name).otherwise(entity)
    )


def _hash(kind: Column, mark: Column, attempt: Column, key: str, salt: str) -> Column:
    """mark is the normal form's own hash, so that long entities aren't hashed over and over."""
    return F.sha2(F.concat_ws("|", F.lit(key), kind, mark, attempt.cast("string"), F.lit(salt)), 256)


def _refill(entity: Column, source: Column) -> Column:
    """The entity with its digits, capitals and small letters replaced, each from the next place of source."""
    place = lambda i: F.substring(source, (i % 180) + 1, 1)
    upper = lambda i: F.translate(place(i), "0123456789", "QBWDRFGHJK")
    small = lambda i: F.translate(place(i), "0123456789", "mbcdzfghjk")
    letters = F.transform(
        F.filter(F.split(entity, ""), lambda c: c != ""),
        lambda c, i: F.when(c.rlike("[0-9]"), place(i)).when(c.rlike(r"\p{Lu}"), upper(i)).when(c.rlike(r"[\p{L}\p{N}]"), small(i)).otherwise(c),
    )
    return F.array_join(letters, "")


def _hex_refill(entity: Column, source: Column) -> Column:
    """The entity's hexadecimal digits replaced by others, in the same case."""
    letters = F.transform(
        F.filter(F.split(entity, ""), lambda c: c != ""),
        lambda c, i: F.when(c.rlike("[A-F]"), F.upper(F.substring(source, (i % 60) + 1, 1))).when(c.rlike("[0-9a-f]"), F.substring(source, (i % 60) + 1, 1)).otherwise(c),
    )
    return F.array_join(letters, "")


def _check_digit(body: Column) -> Column:
    """The Luhn digit for a string of digits."""
    n = F.length(body)
    at = F.sequence(F.lit(1), n)
    doubled = F.transform(at, lambda i: F.substring(body, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1))
    total = F.aggregate(doubled, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x))
    return F.pmod(10 - total % 10, F.lit(10)).cast("string")


def _shaped(entity: Column, normal: Column) -> Column:
    """normal, a new string of digits, put in the places of the entity's digits."""
    letters = F.filter(F.split(entity, ""), lambda c: c != "")
    before = lambda i: F.length(F.regexp_replace(F.substring(entity, F.lit(1), i), "[^0-9]", ""))
    return F.array_join(F.transform(letters, lambda c, i: F.when(c.rlike("[0-9]"), F.substring(normal, before(i) + 1, F.lit(1))).otherwise(c)), "")


def _pick(words: str, hashed: Column, at: int) -> Column:
    """One of the words, by four hexadecimal digits of a hash."""
    listed = words.split()
    return F.element_at(F.array(*map(F.lit, listed)), (F.conv(F.substring(hashed, at, 4), 16, 10).cast("int") % len(listed)) + 1)


def gender_of(entity: Column) -> Column:
    """male or female by title, else by given name, else by a hash-free default of open."""
    title = F.regexp_extract(entity, rf"^({_TITLE})\.? ", 1)
    given = F.lower(F.regexp_extract(entity, rf"^(?:{_TITLE})\.? (\p{{Lu}}[\p{{L}}'’-]+) ", 1))
    return F.when(title.isin(*MALE_TITLES), "male").when(title.isin(*FEMALE_TITLES), "female").when(given.isin(*KNOWN_FEMALE.split()), "female").when(given.isin(*KNOWN_MALE.split()), "male").otherwise("open")


def _script(entity: Column) -> Column:
    return F.when(entity.rlike(r"\p{IsCyrillic}{2}"), "cyrillic").when(entity.rlike(r"\p{IsGreek}{2}"), "greek").otherwise("latin")


def surrogate_key(normal: Column, kind: Column, form: Column, digits: Column, hashed: Column, attempt: int = 0) -> Column:
    """The surrogate's own normal form, from an entity's normal form. form is gender and script for names.

    digits and hashed are keyed: 192 decimal and 64 hexadecimal digits. Later attempts have more surrogates to choose from.
    """
    whole, normal = normal, F.substring(normal, 1, LONGEST)
    more = min(2 * attempt, 10)
    same = lambda n: F.substring(digits, F.lit(1), n)
    card = F.concat(F.substring(normal, 1, 1), F.substring(digits, F.lit(2), F.length(normal) - 2))
    phone = F.concat(F.substring(normal, F.lit(1), F.greatest(F.lit(0), F.length(normal) - 10)), F.substring(digits, F.lit(1), F.least(F.length(normal), F.lit(10))))
    email = F.concat(F.lit("user."), F.substring(hashed, 1, 12), F.lit("@"), F.substring(hashed, 13, 6), F.lit(".example"))
    octet = lambda at: (F.conv(F.substring(hashed, at, 4), 16, 10).cast("int") % 254 + 1).cast("string")
    ip = F.concat_ws(".", octet(13) if attempt else F.lit("10"), octet(1), octet(5), octet(9))
    given, family = F.lit(None).cast("string"), F.lit(None).cast("string")
    joined = lambda names: F.concat_ws("-", *[_pick(names, hashed, 5 + 4 * i) for i in range(1 + attempt)][:12])
    for (gender, script), names in GIVEN.items():
        given = F.when(form == f"{gender} {script}", joined(names)).otherwise(given)
    for script, parts in SYLLABLES.items():
        opened = F.when(F.conv(F.substring(hashed, 1, 1), 16, 10).cast("int") < 8, joined(GIVEN["male", script])).otherwise(joined(GIVEN["female", script]))
        given = F.when(form == f"open {script}", opened).otherwise(given)
        family = F.when(form == script, F.initcap(F.concat(*[_pick(parts, hashed, 5 + 4 * i) for i in range(3 + more)]))).otherwise(family)
    year = F.lpad((F.substring(digits, 1, 4).cast("int") % 9000 + 1000).cast("string"), 4, "0") if attempt else F.concat(F.lit("19"), F.substring(digits, 1, 2))
    month = F.lpad((F.conv(F.substring(hashed, 1, 4), 16, 10).cast("int") % 12 + 1).cast("string"), 2, "0")
    day = F.lpad((F.conv(F.substring(hashed, 5, 4), 16, 10).cast("int") % 28 + 1).cast("string"), 2, "0")
    mark = F.regexp_extract(normal, "([./-])", 1)
    birth = F.when(normal.rlike("^[0-9]{4}-"), F.concat_ws("-", year, month, day)).otherwise(F.concat(day, mark, month, mark, year))
    hexed = normal.rlike("^[0-9A-Fa-f:-]+$")
    # What lies beyond LONGEST characters keeps its classes alone.
    beyond = F.substring(whole, F.lit(LONGEST + 1), F.length(whole))
    for pattern, letter in ((r"\p{N}", "7"), (r"\p{Lu}", "Q"), (r"[^\P{L}Q]", "m")):
        beyond = F.regexp_replace(beyond, pattern, letter)
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", F.concat(card, _check_digit(card))).when(kind == "phone", phone)
        .when(kind == "ssn", F.concat(F.lit("9"), F.substring(digits, F.lit(2), F.length(normal) - 1))).when(kind == "given", given).when(kind == "family", family).when(kind == "birth", birth)
        .when(kind == "iban", F.concat(F.substring(normal, 1, 2), _refill(F.substring(normal, 3, 40), digits)))
        .when(kind.isin("mac", "ipv6") | hexed, F.concat(_hex_refill(normal, hashed), beyond)).otherwise(F.when(F.length(normal) > 0, F.concat(_refill(normal, digits), beyond)).otherwise(same(F.lit(8))))
    )


def in_shape(entity: Column, kind: Column, surrogate: Column, tail: Column) -> Column:
    """The surrogate as it stands in the text, in the entity's own format. A tail is out of any format."""
    letters = F.filter(F.split(entity, ""), lambda c: c != "")
    kept = lambda i: F.length(F.regexp_replace(F.substring(entity, F.lit(1), i), "[ :-]", ""))
    spaced = F.array_join(F.transform(letters, lambda c, i: F.when(c.rlike("[ :-]"), c).when(c.rlike("[a-z]"), F.lower(F.substring(surrogate, kept(i) + 1, F.lit(1)))).otherwise(F.substring(surrogate, kept(i) + 1, F.lit(1)))), "")
    title = F.regexp_extract(entity, rf"^((?:{_TITLE})\.? )", 1)
    lead = F.regexp_extract(entity, f"^{_CUE}", 0)
    email = F.when(entity.rlike(r"^[^\p{Ll}]+$"), F.upper(surrogate)).otherwise(surrogate)
    name = F.when(F.substring(entity, 4, 60).rlike(r"^[^\p{Ll}]+$"), F.upper(surrogate)).otherwise(surrogate)
    shaped = (
        F.when(kind == "email", email).when(kind.isin("phone", "card", "ssn"), _shaped(entity, surrogate)).when(kind.isin("iban", "mac", "ipv6"), spaced)
        .when(kind == "secret", F.concat(lead, surrogate)).when(kind == "name", F.concat(title, name)).otherwise(surrogate)
    )
    return F.concat(shaped, tail)


def parts_of(entity: Column, kind: Column) -> Column:
    """The entities that are mapped one by one: kind, normal, form. A name's are its given name, if it has one, and family name."""
    normal = _normal(entity, kind)
    part = lambda k, n, f: F.struct(k.alias("kind"), n.alias("normal"), f.alias("form"))
    given, family = F.substring_index(normal, " ", 1), F.substring_index(normal, " ", -1)
    script = _script(entity)
    last = part(F.lit("family"), family, script)
    both = F.array(part(F.lit("given"), given, F.concat_ws(" ", gender_of(entity), script)), last)
    return F.when(kind == "name", F.when(normal.contains(" "), both).otherwise(F.array(last))).otherwise(F.array(part(kind, normal, F.lit(""))))


def found_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def distinct_surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """kind, normal, form, surrogate, tail for each row of entities (kind, normal, form, all different), without collisions.

    The first of the entities that share a surrogate keeps it; the others try again, as does one whose surrogate is
    itself an entity. A round handles only what the round before left.
    """
    done, attempt, open_ = None, 0, entities
    real = entities.select("kind", F.lower("normal").alias("made")).distinct()
    while True:
        if attempt == NEVER:
            raise RuntimeError("surrogates collide again and again")
        made = surrogate_key(F.col("normal"), F.col("kind"), F.col("form"), F.col("digits"), F.col("hashed"), min(attempt, LAST))
        hashes = [_hash(F.col("kind"), F.sha2(F.concat_ws("|", "form", "normal"), 256), F.lit(attempt), key, salt) for salt in "01234"]
        tail = F.concat(F.lit("-"), F.substring(hashes[4], 1, 16)) if attempt >= LAST else F.lit("")
        drawn = open_.withColumn("digits", F.translate(F.concat(*hashes[:3]), "abcdef", "394071")).withColumn("hashed", hashes[3]).withColumn("tail", tail)
        drawn = stage(drawn, "pii-drawn")
        tried = drawn.select("kind", "normal", "form", F.lit(attempt).alias("attempt"), made.alias("surrogate"), "tail")
        tried = stage(tried.withColumn("made", F.lower(F.concat("surrogate", "tail"))), "pii-tried")
        first = tried.groupBy("kind", "made").agg(F.min(F.struct("normal", "form")).alias("first"), F.count("*").alias("n"))
        bad = first.where("n > 1").select("kind", "made", F.col("first.normal").alias("keeper"), F.col("first.form").alias("keeper_form"))
        taken = tried.select("kind", "made").join(real, ["kind", "made"], "left_semi")
        if done is not None:
            taken = taken.unionByName(tried.select("kind", "made").join(done.select("kind", "made"), ["kind", "made"], "left_semi"))
        worse = bad.unionByName(taken.distinct().select("kind", "made", F.lit(None).cast("string").alias("keeper"), F.lit(None).cast("string").alias("keeper_form")))
        worse = stage(worse.groupBy("kind", "made").agg(F.max(F.col("keeper").isNull()).alias("none"), F.max("keeper").alias("keeper"), F.max("keeper_form").alias("keeper_form")), "pii-bad")
        if worse.isEmpty():
            drop(drawn, worse)
            return tried if done is None else done.unionByName(tried)
        marked = tried.join(worse, ["kind", "made"], "left")
        again = F.coalesce(F.col("none") | (F.struct("normal", "form") != F.struct(F.col("keeper").alias("normal"), F.col("keeper_form").alias("form"))), F.lit(False))
        fine = marked.where(~again).select(*tried.columns)
        before, done = done, stage(fine if done is None else done.unionByName(fine), "pii-done")
        open_ = stage(marked.where(again).select("kind", "normal", "form"), "pii-open")
        drop(drawn, tried, worse, *([before] if before is not None else []))
        attempt += 1


def replace_all(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc (a struct of docs' columns, with surrogates in text) and n_entities, for each row of docs."""
    key = key or docs.sparkSession.conf.get("turnstone.pii.key", KEY)
    text = F.col("doc.text")
    rows = docs.select(F.struct("*").alias("doc"))
    # The pattern is dear, so each text meets it once; all rows are written with what it found.
    found = F.coalesce(found_in(text), F.array().cast("array<string>"))
    read = stage(rows.select("doc", found.alias("found"), F.monotonically_increasing_id().alias("row")), "pii-found")
    holders = read.where(F.size("found") > 0)
    each = holders.select("row", F.posexplode("found").alias("at", "entity")).withColumn("kind", _kind(F.col("entity")))
    each = stage(each.select("row", "at", "entity", F.col("kind").alias("type"), F.posexplode(parts_of(F.col("entity"), F.col("kind"))).alias("part", "own")), "pii-entities")
    each = each.select("row", "at", "entity", "type", "part", "own.*")
    mapping = distinct_surrogates(stage(each.select("kind", "normal", "form").distinct(), "pii-distinct"), key)
    placed = each.join(mapping.select("kind", "normal", "form", "surrogate", "tail"), ["kind", "normal", "form"])
    # A name's parts are put together again; few entities have two.
    one = placed.where("type <> 'name'").select("row", "at", "entity", "type", "surrogate", "tail")
    names = placed.where("type = 'name'").groupBy("row", "at", "entity", "type").agg(F.array_sort(F.collect_list(F.struct("part", "surrogate", "tail"))).alias("parts"))
    names = names.select("row", "at", "entity", "type", F.array_join(F.transform("parts", lambda x: F.concat(x["surrogate"], x["tail"])), " ").alias("surrogate"), F.lit("").alias("tail"))
    placed = one.unionByName(names).select("row", "at", in_shape(F.col("entity"), F.col("type"), F.col("surrogate"), F.col("tail")).alias("new"))
    new = placed.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]).alias("new"))
    filled = F.array_join(F.transform(F.split(text, ANY, -1), lambda gap, i: F.concat(gap, F.coalesce(F.get(F.col("new"), i), F.lit("")))), "")
    changed = holders.join(new, "row").select(F.col("doc").withField("text", filled).alias("doc"), F.size("found").alias("n_entities"))
    return changed.unionByName(read.where(F.size("found") == 0).select("doc", F.lit(0).alias("n_entities")))

"""SQL of normal texts."""

from __future__ import annotations


def wer_sql(text: str) -> str:
    """wer_normal without look-arounds: inner marks are kept by a sign before them, in two passes as they may share a letter."""
    low = f"replace(replace(lower(nfc_normalize({text})), '’', ''''), '`', '''')"
    kept = f"regexp_replace({low}, '([\\p{{L}}\\p{{N}}])([''\\-._])([\\p{{L}}\\p{{N}}])', '\\1\x01\\2\\3', 'g')"
    kept = f"regexp_replace({kept}, '([\\p{{L}}\\p{{N}}])([''\\-._])([\\p{{L}}\\p{{N}}])', '\\1\x01\\2\\3', 'g')"
    bare = kept
    for mark, name in (("''", "a"), ("-", "b"), (".", "c"), ("_", "d")):
        bare = f"replace({bare}, '\x01{mark}', '\x01{name}')"
    bare = f"regexp_replace({bare}, '[\\p{{P}}]', ' ', 'g')"
    for mark, name in (("''", "a"), ("-", "b"), (".", "c"), ("_", "d")):
        bare = f"replace({bare}, '\x01{name}', '{mark}')"
    return f"trim(regexp_replace({bare}, '\\s+', ' ', 'g'))"

"""Tokens, stop words and English stems as column expressions.

The stemmer follows the Porter algorithm (Porter 1980). A step runs only on words with one of
its endings. Steps that must act on the longest matching suffix first set a ``~`` before it;
the measure of the stem is then tested by a pattern that cannot cross the mark.
"""

from pyspark.sql import functions as F

# The usual English stop words of full-text search.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is "
    "are was were be been being have has had having do does did doing a an the and but if or because as until "
    "while of at by for with about against between into through during before after above below to from up "
    "down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()

# A number with dots (version, address) is one token, else runs of letters and digits.
TOKEN = r"[0-9]+(?:\.[0-9]+)+|[\p{L}\p{N}]+"


def _column(c):
    return F.col(c) if isinstance(c, str) else c


def tokens(text):
    """Lower-cased tokens in order; null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(_column(text), F.lit(""))), F.lit(TOKEN), F.lit(0))


# consonant run, vowel run, and the measure tests "m > 0", "m = 1", "m > 1", "has a vowel"
_C = "[b-df-hj-np-tv-zY][b-df-hj-np-tv-xzY]*"
_V = "[aeiouy][aeiou]*"
_M0 = f"(?:{_C})?{_V}{_C}[a-zY]*"
_M1 = f"(?:{_C})?{_V}{_C}{_V}{_C}[a-zY]*"
_MEQ1 = f"(?:{_C})?{_V}{_C}(?:{_V})?"
_HAS_V = f"(?:{_C})?[aeiouy][a-zY]*"
_CVC = f"{_C}[aeiouy][b-df-hj-np-tvzY]"

_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize").split()


def _suffix_step(rules):
    """Mark the longest suffix, rewrite it where the stem has a measure, drop the mark."""
    yield "^([a-zY]+?)(" + "|".join(rules) + ")$", "$1~$2"
    by_target = {}
    for suffix, target in rules.items():
        by_target.setdefault(target, []).append(suffix)
    for target, suffixes in by_target.items():
        yield f"^({_M0})~(?:{'|'.join(suffixes)})$", f"$1{target}"
    yield "~", ""


# (endings that call for the step, its rules)
_STEPS = [
    # 1a plurals
    (["s"], [("^([a-zY]+)(ss|i)es$", "$1$2"), ("^([a-zY]+[^s])s$", "$1")]),
    # 1b past and progressive forms; the mark asks for the repair rules
    (["ed", "ing"], [
        (f"^({_M0})eed$", "$1ee"), (f"^({_HAS_V})(?:(?<!e)ed|ing)$", "$1~"),
        ("(at|bl|iz)~$", "$1e"), (r"([b-df-hj-kmnp-rtv-xY])\1~$", "$1"), (f"^({_CVC})~$", "$1e"), ("~$", "")]),
    # 1c
    (["y"], [(f"^({_HAS_V})y$", "$1i")]),
    (list(_STEP2), list(_suffix_step(_STEP2))),
    (list(_STEP3), list(_suffix_step(_STEP3))),
    # 4
    ([*_STEP4, "ion"], [
        ("^([a-zY]+?)(" + "|".join(_STEP4) + "|(?<=[st])ion)$", "$1~$2"), (f"^({_M1})~[a-z]*$", "$1"), ("~", "")]),
    # 5
    (["e"], [(f"^({_M1})e$", "$1"), (f"^(?!{_CVC}e$)({_MEQ1})e$", "$1")]),
    (["ll"], [(f"^(?={_M1})([a-zY]+l)l$", "$1")]),
]


def _step(endings, rules):
    def apply(word):
        called, changed = F.lit(False), word
        for ending in endings:
            called = called | F.endswith(word, F.lit(ending))
        for pattern, replacement in rules:
            changed = F.regexp_replace(changed, pattern, replacement)
        return F.when(called, changed).otherwise(word)
    return apply


def stem(token):
    """Porter stem of a lower-case token; other than plain a-z words of three letters stay."""
    token = _column(token)
    word = F.array(F.regexp_replace(token, "^y", "Y"))
    for endings, rules in _STEPS:
        word = F.transform(word, _step(endings, rules))
    return F.when(F.rlike(token, F.lit("^[a-z]{3,}$")), F.regexp_replace(word[0], "^Y", "y")).otherwise(token)

"""English suffix stemming as a column expression, a chain of named steps.

The rules are those of the Snowball English stemmer (Porter's second). A word's regions are kept as the numbers of
letters before them, since suffixes leave the places alone; a y that acts as a consonant is written Y meanwhile.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the published algorithm.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during "
    "before after above below to from up down in out on off over under again further then once here there when where why how all any "
    "both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURALS = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
LONG_PREFIXES = ("gener", "commun", "arsen")
SECOND = {
    "ational": "ate", "ization": "ize", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less",
    "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance",
    "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
FOURTH = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")

VOWEL = "[aeiouy]"
REGION = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
SHORT_END = "(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"
DOUBLE_END = "(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"


def _ending(w: Column, suffixes) -> Column:
    """The longest of the suffixes (longest first) that the word ends in, or ''."""
    return F.regexp_extract(w, f"({'|'.join(suffixes)})$", 1)


def _cut(w: Column, suffix: Column) -> Column:
    return F.substr(w, F.lit(1), F.length(w) - F.length(suffix))


def _mapped(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _region(text: Column) -> Column:
    """The letters up to the first consonant after a vowel; all if there is none."""
    found = F.length(F.regexp_extract(text, REGION, 0))
    return F.when(found > 0, found).otherwise(F.length(text))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once: a step names what the step before it gave, so the whole stays as long as
    the list of steps, also where the optimiser moves it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _state(w: Column, of: Column, **more: Column) -> Column:
    """A step's result: the word with its regions, whether it stays as it is, and what the next step needs."""
    return F.struct(w.alias("w"), of["p1"].alias("p1"), of["p2"].alias("p2"), of["kept"].alias("kept"), *[c.alias(k) for k, c in more.items()])


def _started(word: Column) -> Column:
    prefix = lambda w: F.length(F.regexp_extract(w, f"^({'|'.join(LONG_PREFIXES)})", 1))
    marked = F.regexp_replace(F.regexp_replace(word, "^y", "Y"), "([aeiouy])y", "$1Y")
    first = _let(marked, lambda w: F.struct(w.alias("w"), F.when(prefix(w) > 0, prefix(w)).otherwise(_region(w)).alias("p1")))
    return _let(first, lambda t: F.struct(t["w"].alias("w"), t["p1"].alias("p1"), (t["p1"] + _region(F.substr(t["w"], t["p1"] + 1, F.length(t["w"])))).alias("p2")))


def _plural(t: Column) -> Column:
    w = t["w"]
    cut = F.when(w.endswith("sses"), _cut(w, F.lit("es"))).when(w.rlike("ie[ds]$"), _cut(w, F.when(F.length(w) > 4, "es").otherwise("s")))
    cut = cut.when(w.rlike("[us]s$"), w).when(w.rlike(rf"{VOWEL}.+s$"), _cut(w, F.lit("s"))).otherwise(w)
    return _let(cut, lambda x: F.struct(x.alias("w"), t["p1"].alias("p1"), t["p2"].alias("p2"), x.isin(*KEPT_AFTER_PLURALS).alias("kept")))


def _with_ending(t: Column, suffixes) -> Column:
    """The state with `s`, the suffix that a step looks at, and `b`, the word without it."""
    return _let(_ending(t["w"], suffixes), lambda s: _state(t["w"], t, s=s, b=_cut(t["w"], s)))


def _past(t: Column) -> Column:
    w, s, b = t["w"], t["s"], t["b"]
    short = b.rlike(SHORT_END) & (F.length(b) == t["p1"])
    mended = F.when(b.rlike("(?:at|bl|iz)$") | short & ~b.rlike(DOUBLE_END), F.concat(b, F.lit("e"))).when(b.rlike(DOUBLE_END), _cut(b, F.lit("x"))).otherwise(b)
    out = F.when(s.isin("eed", "eedly"), F.when(F.length(b) >= t["p1"], F.concat(b, F.lit("ee"))).otherwise(w)).when((s != "") & b.rlike(VOWEL), mended).otherwise(w)
    return _state(F.regexp_replace(out, "^(.+[^aeiouy])[yY]$", "$1i"), t)


def _second(t: Column) -> Column:
    s = t["s"]
    fits = (F.length(t["b"]) >= t["p1"]) & F.when(s == "ogi", t["w"].endswith("logi")).when(s == "li", t["w"].rlike("[cdeghkmnrt]li$")).otherwise(s != "")
    return _state(F.when(fits, F.concat(t["b"], _mapped(SECOND, s))).otherwise(t["w"]), t)


def _third(t: Column) -> Column:
    s = t["s"]
    fits = (s != "") & (F.length(t["b"]) >= F.when(s == "ative", t["p2"]).otherwise(t["p1"]))
    return _state(F.when(fits, F.concat(t["b"], _mapped(THIRD, s))).otherwise(t["w"]), t)


def _fourth(t: Column) -> Column:
    fits = (t["s"] != "") & (F.length(t["b"]) >= t["p2"]) & ((t["s"] != "ion") | t["w"].rlike("[st]ion$"))
    return _let(F.when(fits, t["b"]).otherwise(t["w"]), lambda x: _state(x, t, b=_cut(x, F.lit("x"))))


def _last(t: Column) -> Column:
    size = F.length(t["b"])
    last_e = t["w"].endswith("e") & ((size >= t["p2"]) | (size >= t["p1"]) & ~t["b"].rlike(SHORT_END))
    return F.when(last_e | t["w"].endswith("ll") & (size >= t["p2"]), t["b"]).otherwise(t["w"])


def stem_of(word: Column) -> Column:
    """The stem of a lower-case word. Words of one or two letters and those with anything but letters are their own
    stems. The expression has thousands of parts: stem distinct words, not every occurrence."""
    suffixes = ((("eedly", "ingly", "edly", "eed", "ing", "ed"), _past), (SECOND, _second), (THIRD, _third), (FOURTH, _fourth))

    def rest(t: Column, step: int = 0) -> Column:
        if step == len(suffixes):
            return _last(t)
        endings, rule = suffixes[step]
        return _let(_let(_with_ending(t, endings), rule), lambda x: rest(x, step + 1))

    found = _let(_let(_started(word), _plural), lambda t: F.when(t["kept"], t["w"]).otherwise(rest(t)))
    own = (F.length(word) <= 2) | ~word.rlike(r"^\p{L}+$")
    return F.when(own, word).when(word.isin(*EXCEPTIONS), _mapped(EXCEPTIONS, word)).otherwise(F.replace(found, F.lit("Y"), F.lit("y")))


@functools.cache
def _stem_column(word: str, context: int) -> Column:
    return stem_of(F.col(word))


def with_stems(words: DataFrame, word: str = "word", stem: str = "stem") -> DataFrame:
    """The rows with the stem of their word. The words are dealt anew to as many tasks as a shuffle has, since stemming
    takes much time for few bytes."""
    spark = words.sparkSession
    column = _stem_column(word, id(spark.sparkContext))  # made once a context
    return words.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), word).withColumn(stem, column)

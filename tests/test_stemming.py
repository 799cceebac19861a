import random

from factloom.functions.stemming import EXCEPTIONS, FOURTH, KEPT_AFTER_PLURALS, SECOND, THIRD, with_stems

V = "aeiouy"


def plain_stem(word):
    """The published rules a letter at a time."""
    if len(word) <= 2 or not word.isalpha():
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    w = list(word)
    for i, c in enumerate(w):
        if c == "y" and (i == 0 or w[i - 1] in V):
            w[i] = "Y"
    w = "".join(w)

    def region(at):
        for i in range(at + 1, len(w)):
            if w[i] not in V and w[i - 1] in V:
                return i + 1
        return len(w)

    p1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or region(0)
    p2 = region(p1) if p1 < len(w) else p1

    def short_end(x):
        if len(x) == 2:
            return x[0] in V and x[1] not in V
        return len(x) > 2 and x[-3] not in V and x[-2] in V and x[-1] not in V + "wxY"

    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith(("us", "ss")):
        pass
    elif w.endswith("s") and any(c in V for c in w[:-2]):
        w = w[:-1]
    if w in KEPT_AFTER_PLURALS:
        return w
    for s in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(s):
            b = w[: -len(s)]
            if s.startswith("eed"):
                w = b + "ee" if len(b) >= p1 else w
            elif any(c in V for c in b):
                if b.endswith(("at", "bl", "iz")):
                    b += "e"
                elif b[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
                    b = b[:-1]
                elif short_end(b) and len(b) == p1:
                    b += "e"
                w = b
            break
    if w[-1] in "yY" and len(w) > 2 and w[-2] not in V:
        w = w[:-1] + "i"
    for s in sorted(SECOND, key=len, reverse=True):
        if w.endswith(s):
            if len(w) - len(s) >= p1 and (s != "ogi" or w.endswith("logi")) and (s != "li" or (len(w) > 2 and w[-3] in "cdeghkmnrt")):
                w = w[: -len(s)] + SECOND[s]
            break
    for s in sorted(THIRD, key=len, reverse=True):
        if w.endswith(s):
            if len(w) - len(s) >= (p2 if s == "ative" else p1):
                w = w[: -len(s)] + THIRD[s]
            break
    for s in sorted(FOURTH, key=len, reverse=True):
        if w.endswith(s):
            if len(w) - len(s) >= p2 and (s != "ion" or w[:-3].endswith(("s", "t"))):
                w = w[: -len(s)]
            break
    b = w[:-1]
    if w.endswith("e") and (len(b) >= p2 or len(b) >= p1 and not short_end(b)) or w.endswith("ll") and len(b) >= p2:
        w = b
    return w.replace("Y", "y")


# Words of the published vocabulary with their stems.
KNOWN = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consist": "consist", "consisted": "consist", "consistency": "consist",
    "consistent": "consist", "consistently": "consist", "consolation": "consol", "consolations": "consol", "consolatory": "consolatori", "conspicuously": "conspicu",
    "conspiracy": "conspiraci", "constable": "constabl", "constancy": "constanc", "knack": "knack", "knackeries": "knackeri", "kneaded": "knead", "kneeling": "kneel",
    "knightly": "knight", "knives": "knive", "knots": "knot", "generate": "generat", "generally": "general", "communism": "communism", "hopping": "hop", "hoping": "hope",
    "falling": "fall", "luxuriated": "luxuri", "flies": "fli", "dies": "die", "ties": "tie", "cries": "cri", "gas": "gas", "gaps": "gap", "kiwis": "kiwi", "say": "say",
    "by": "by", "cry": "cri", "relational": "relat", "controll": "control", "sensational": "sensat", "ability": "abil", "happily": "happili", "news": "news", "inning": "inning",
    "national": "nation", "running": "run", "youth": "youth", "enjoy": "enjoy", "allocations": "alloc", "budgeting": "budget", "proceed": "proceed", "proceeds": "proceed",
}


def stems(spark, words):
    got = {r["word"]: r["stem"] for r in with_stems(spark.createDataFrame([(w, 1) for w in words], "word string, x int")).collect()}
    assert set(got) == set(words)
    return got


def test_known_stems(spark):
    assert stems(spark, KNOWN) == KNOWN
    assert {w: plain_stem(w) for w in KNOWN} == KNOWN


def test_stems_match_plain_rules(spark):
    rng = random.Random(4)
    ends = ["", "s", "es", "ies", "ied", "ed", "edly", "ing", "ingly", "eed", "eedly", "y", "ly", "sses", "us", *SECOND, *THIRD, *FOURTH, "e", "ll", "le", "ement", "ogy", "ology"]
    words = {"".join(rng.choice("aeiouybcdlmnrstxwg") for _ in range(rng.randrange(0, 8))) + rng.choice(ends) for _ in range(6000)}
    words |= {"a1b", "42", "zwölf", "ärger", "süße", "generalizations", "arsenals"}
    words.discard("")
    assert stems(spark, words) == {w: plain_stem(w) for w in words}

"""Stemmers. English follows the published Porter2 algorithm; German, Spanish, Swedish, Norwegian and Danish here and five more in stems_more the published Snowball algorithms; others are lower-cased only."""

from __future__ import annotations

import re

from .stems_more import dutch, french, italian, portuguese, russian

VOWELS = "aeiouy"
# Fixed values of the published algorithm.
SPECIAL = {
    "skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AS_IS = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "fulli": "ful", "lessli": "less",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _regions(w: str) -> tuple[int, int]:
    def after(at: int) -> int:
        m = re.compile(r"[aeiouy][^aeiouy]").search(w, at)
        return m.end() if m else len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _short_end(w: str) -> bool:
    return bool(re.search(r"(^|[^aeiouy])[aeiouy][^aeiouywxY]$", w) if len(w) > 2 else re.fullmatch(r"[aeiouy][^aeiouy]", w))


def _longest(w: str, endings) -> str | None:
    return max((e for e in endings if w.endswith(e)), key=len, default=None) if w.endswith(tuple(endings)) else None


#: How words end that a rule of english() may change.
CHANGED = tuple({"'", "s", "y", "e", "i", "ed", "ing", "ll", "ion", *STEP2, *STEP3, *STEP4})


def english(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    if not word.endswith(CHANGED) and word[0] != "'":
        return word.lower()
    w = word.lstrip("'")
    w = re.sub(r"(^|[aeiouy])y", lambda m: m[1] + "Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"('s'|'s|')$", "", w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith(("us", "ss")):
        pass
    elif w.endswith("s") and re.search(r"[aeiouy].+s$", w):
        w = w[:-1]
    if w in AS_IS:
        return w
    # past and present participles
    e = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if e in ("eed", "eedly"):
        if len(w) - len(e) >= r1:
            w = w[: -len(e)] + "ee"
    elif e and re.search("[aeiouy]", w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    e = _longest(w, (*STEP2, "ogi", "li"))
    if e and len(w) - len(e) >= r1:
        if e == "ogi":
            w = w[:-1] if w.endswith("logi") else w
        elif e == "li":
            w = w[:-2] if len(w) > 2 and w[-3] in "cdeghkmnrt" else w
        else:
            w = w[: -len(e)] + STEP2[e]
    e = _longest(w, (*STEP3, "ative"))
    if e and len(w) - len(e) >= r1:
        if e != "ative":
            w = w[: -len(e)] + STEP3[e]
        elif len(w) - len(e) >= r2:
            w = w[:-5]
    e = _longest(w, (*STEP4, "ion"))
    if e and len(w) - len(e) >= r2 and (e != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(e)]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def _same(word: str) -> str:
    return word


def _r1(word: str, vowels: str) -> int:
    """Start of the region after the first consonant that follows a vowel, with three letters before it at least."""
    m = re.search(f"[{vowels}][^{vowels}]", word)
    return max(3, m.end()) if m else len(word)


def _drop(word: str, r1: int, endings) -> tuple[str, str | None]:
    e = max((e for e in endings if word.endswith(e) and len(word) - len(e) >= r1), key=len, default=None)
    return (word[: -len(e)], e) if e else (word, None)


def german(word: str) -> str:
    v = "aeiouyäöü"
    w = word.replace("ß", "ss")
    w = re.sub(f"(?<=[{v}])([uy])(?=[{v}])", lambda m: m[1].upper(), w)
    m = re.search(f"[{v}][^{v}]", w)
    start = m.end() if m else len(w)
    m = re.compile(f"[{v}][^{v}]").search(w, start)
    r1, r2 = max(3, start), m.end() if m else len(w)
    e = _longest(w, ("em", "ern", "er", "e", "en", "es", "s"))
    if e and len(w) - len(e) >= r1:
        if e == "s":
            w = w[:-1] if len(w) > 1 and w[-2] in "bdfghklmnrt" else w
        else:
            w = w[: -len(e)]
            if e in ("e", "en", "es") and w.endswith("niss"):
                w = w[:-1]
    e = _longest(w, ("en", "er", "est", "st"))
    if e and len(w) - len(e) >= r1:
        if e != "st":
            w = w[: -len(e)]
        elif len(w) >= 6 and w[-3] in "bdfghklmnt":
            w = w[:-2]
    e = _longest(w, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    if e and len(w) - len(e) >= r2:
        base = w[: -len(e)]
        if e in ("end", "ung"):
            w = base[:-2] if base.endswith("ig") and not base.endswith("eig") and len(base) - 2 >= r2 else base
        elif e in ("ig", "ik", "isch"):
            w = w if base.endswith("e") else base
        elif e in ("lich", "heit"):
            w = base[:-2] if base.endswith(("er", "en")) and len(base) - 2 >= r1 else base
        else:
            k = next((x for x in ("lich", "ig") if base.endswith(x) and len(base) - len(x) >= r2), "")
            w = base[: len(base) - len(k)]
    return w.lower().translate(str.maketrans("äöü", "aou"))


# Fixed values of the published Scandinavian algorithms.
SV = (
    "a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast"
).split()
NO = "a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast".split()
DA = (
    "hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret"
).split()


def swedish(word: str) -> str:
    r1 = _r1(word, "aeiouyäåö")
    w, e = _drop(word, r1, [*SV, "s"])
    if e == "s" and not (w and w[-1] in "bcdfghjklmnoprtvy"):
        w = word
    if w.endswith(("dd", "gd", "nn", "dt", "gt", "kt", "tt")) and len(w) - 2 >= r1:
        w = w[:-1]
    for end, to in (("fullt", "full"), ("löst", "lös"), ("lig", ""), ("els", ""), ("ig", "")):
        if w.endswith(end) and len(w) - len(end) >= r1:
            return w[: -len(end)] + to
    return w


def norwegian(word: str) -> str:
    r1 = _r1(word, "aeiouyæåø")
    w, e = _drop(word, r1, [*NO, "s", "erte", "ert"])
    if e in ("erte", "ert"):
        w += "er"
    elif e == "s" and not (w and (w[-1] in "bcdfghjlmnoprtvyz" or w[-1] == "k" and len(w) > 1 and w[-2] not in "aeiouyæåø")):
        w = word
    if w.endswith(("dt", "vt")) and len(w) - 2 >= r1:
        w = w[:-1]
    return _drop(w, r1, ("leg", "eleg", "ig", "eig", "lig", "elig", "els", "lov", "elov", "slov", "hetslov"))[0]


def danish(word: str) -> str:
    r1 = _r1(word, "aeiouyæåø")
    w, e = _drop(word, r1, [*DA, "s"])
    if e == "s" and not (w and w[-1] in "abcdfghjklmnoprtvyzå"):
        w = word

    def pair(x: str) -> str:
        return x[:-1] if x.endswith(("gd", "dt", "gt", "kt")) and len(x) - 2 >= r1 else x

    w = pair(w)
    if w.endswith("igst"):
        w = w[:-2]
    if w.endswith("løst") and len(w) - 4 >= r1:
        w = w[:-1]
    else:
        w, e = _drop(w, r1, ("ig", "lig", "elig", "els"))
        w = pair(w) if e else w
    if len(w) - 2 >= r1 - 1 and len(w) > r1 and len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeiouyæåø":
        w = w[:-1]
    return w


# Fixed values of the published Spanish algorithm.
ES_PRONOUNS = ("me", "se", "sela", "selo", "selas", "selos", "la", "le", "lo", "las", "les", "los", "nos")
ES_DELETE = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
ES_IC = "adora ador ación adoras adores aciones ante antes ancia ancias acion".split()
ES_Y = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
ES_VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré "
    "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais "
    "arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()


def spanish(word: str) -> str:
    v, plain = "aeiouáéíóúü", str.maketrans("áéíóú", "aeiou")
    w = word
    m = re.search(f"[{v}][^{v}]", w)
    r1 = m.end() if m else len(w)
    m = re.compile(f"[{v}][^{v}]").search(w, r1)
    r2 = m.end() if m else len(w)
    rv = len(w)
    if len(w) > 2:
        if w[1] not in v:
            rv = next((i + 1 for i in range(2, len(w)) if w[i] in v), len(w))
        elif w[0] in v:
            rv = next((i + 1 for i in range(2, len(w)) if w[i] not in v), len(w))
        else:
            rv = 3
    inside = lambda e, r: len(w) - len(e) >= r
    p = _longest(w, ES_PRONOUNS)
    if p and inside(p, rv):
        base = w[: -len(p)]
        g = _longest(base, ("iéndo", "ándo", "ár", "ér", "ír", "ando", "iendo", "ar", "er", "ir", "yendo"))
        if g and len(base) - len(g) >= rv and (g != "yendo" or base.endswith("uyendo")):
            w = base[: -len(g)] + (g.translate(plain) if g in ("iéndo", "ándo", "ár", "ér", "ír") else g)
    before = w
    e = _longest(w, (*ES_DELETE, *ES_IC, "logía", "logías", "ución", "uciones", "encia", "encias", "amente", "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos"))
    cut = lambda ends: next((w[: -len(x)] for x in ends if w.endswith(x) and len(w) - len(x) >= r2), w)
    if e == "amente" and inside(e, r1):
        w = w[:-6]
        if w.endswith("iv") and len(w) - 2 >= r2:
            w = w[:-2]
            w = cut(("at",))
        else:
            w = cut(("os", "ic", "ad"))
    elif e and e != "amente" and inside(e, r2):
        if e in ("logía", "logías"):
            w = w[: -len(e)] + "log"
        elif e in ("ución", "uciones"):
            w = w[: -len(e)] + "u"
        elif e in ("encia", "encias"):
            w = w[: -len(e)] + "ente"
        else:
            w = w[: -len(e)]
            w = cut({"mente": ("ante", "able", "ible"), "idad": ("abil", "ic", "iv"), "idades": ("abil", "ic", "iv")}.get(e, ("at",) if e[:2] == "iv" else ("ic",) if e in ES_IC else ()))
    if w == before:
        y = _longest(w, ES_Y)
        if y and inside(y, rv) and w[: -len(y)].endswith("u"):
            w = w[: -len(y)]
        else:
            e = _longest(w, [x for x in ES_VERBS if len(w) - len(x) >= rv])
            f = _longest(w, [x for x in ("en", "es", "éis", "emos") if len(w) - len(x) >= rv])
            if f and (not e or len(f) > len(e)):
                w = w[: -len(f)]
                w = w[:-1] if w.endswith("gu") else w
            elif e:
                w = w[: -len(e)]
    e = _longest(w, [x for x in ("os", "a", "o", "á", "í", "ó", "e", "é") if len(w) - len(x) >= rv])
    if e:
        w = w[: -len(e)]
        if e in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(plain)


#: Stopwords and stemmer of each language.
LANGUAGES = {code: (frozenset(), _same) for code in "ar da de el es fi fr hu it nl no pt ro ru sv tr".split()}
LANGUAGES |= {code: (frozenset(), stem) for code, stem in (("de", german), ("sv", swedish), ("no", norwegian), ("da", danish), ("es", spanish))}
LANGUAGES |= {code: (frozenset(), stem) for code, stem in (("fr", french), ("it", italian), ("pt", portuguese), ("nl", dutch), ("ru", russian))}

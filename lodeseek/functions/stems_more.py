"""French, Italian, Portuguese, Dutch and Russian stems by the published Snowball algorithms."""

from __future__ import annotations

import re
from collections.abc import Iterable


class Word:
    """A word whose end is cut, with its regions as positions."""

    def __init__(self, text: str, vowels: str):
        self.text, self.vowels = text, vowels
        self.r1 = self._after(0)
        self.r2 = self._after(self.r1)
        self.rv = len(text)

    def _after(self, at: int) -> int:
        m = re.compile(f"[{self.vowels}][^{self.vowels}]").search(self.text, at)
        return m.end() if m else len(self.text)

    def find(self, endings: Iterable[str], region: int = 0) -> str | None:
        """The longest ending that the word has within a region."""
        return max((e for e in endings if self.text.endswith(e) and len(self.text) - len(e) >= region), key=len, default=None)

    def inside(self, ending: str, region: int) -> bool:
        return len(self.text) - len(ending) >= region

    def cut(self, ending: str, put: str = "") -> None:
        self.text = self.text[: len(self.text) - len(ending)] + put

    def drop(self, endings: Iterable[str], region: int) -> str | None:
        """Cuts the longest of the endings if it lies in the region."""
        e = self.find(endings)
        if e and self.inside(e, region):
            self.cut(e)
            return e
        return None

    def romance_rv(self) -> int:
        """After the vowel that follows a second consonant, the consonant that follows two vowels, or the third letter."""
        t, v = self.text, self.vowels
        if len(t) < 2:
            return len(t)
        if t[1] not in v:
            return next((i + 1 for i in range(2, len(t)) if t[i] in v), len(t))
        if t[0] in v:
            return next((i + 1 for i in range(2, len(t)) if t[i] not in v), len(t))
        return min(3, len(t))


# Fixed values of the published algorithms: the endings of each step.
FR_PLAIN = "ance iqUe isme able iste eux ances iqUes ismes ables istes".split()
FR_I = (
    "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez "
    "issiez issions issons it"
).split()
FR_E = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
FR_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()
IT_PRONOUNS = (
    "ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene"
).split()
IT_PLAIN = "anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti".split()
IT_VERBS = (
    "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete "
    "erò erono essero ete eva evamo evano evate evi evo Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita "
    "ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir"
).split()
PT_PLAIN = (
    "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância"
).split()
PT_VERBS = (
    "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo "
    "indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis "
    "iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos "
    "íssemos imos armos ermos irmos eu iu ou ira iras"
).split()
RU_GERUND_A, RU_GERUND = "в вши вшись".split(), "ив ивши ившись ыв ывши ывшись".split()
RU_ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
RU_PARTICIPLE_A, RU_PARTICIPLE = "ем нн вш ющ щ".split(), "ивш ывш ующ".split()
RU_VERB_A = "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split()
RU_VERB = "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split()
RU_NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()


def french(word: str) -> str:
    v = "aeiouyâàëéêèïîôûù"
    t = re.sub(f"(?<=[{v}])([ui])(?=[{v}])", lambda m: m[1].upper(), word)
    t = re.sub(f"(?<=[{v}])y|y(?=[{v}])", "Y", t)
    t = re.sub("(?<=q)u", "U", t)
    w = Word(t, v)
    if t[:3] in ("par", "col", "tap") or len(t) > 1 and t[0] in v and t[1] in v:
        w.rv = min(3, len(t))
    else:
        w.rv = next((i + 1 for i in range(1, len(t)) if t[i] in v), len(t))
    before, verbal = w.text, not _french_noun(w)
    if verbal and not _french_i(w):
        e = w.find([*FR_E, *FR_A, "ions"], w.rv)
        if e == "ions":
            if w.inside(e, w.r2):
                w.cut(e)
        elif e:
            w.cut(e)
            if e in FR_A and w.text.endswith("e") and w.inside("e", w.rv):
                w.cut("e")
    if w.text != before:
        w.text = re.sub("Y$", "i", re.sub("ç$", "c", w.text))
    else:
        if re.search("[^aiouès]s$", w.text):
            w.cut("s")
        e = w.find(("ion", "ier", "ière", "Ier", "Ière", "e", "ë"), w.rv)
        if e == "ion":
            if w.inside(e, w.r2) and w.text[:-3].endswith(("s", "t")) and w.inside("xion", w.rv):
                w.cut(e)
        elif e in ("e", "ë"):
            if e == "e" or w.text.endswith("guë"):
                w.cut(e)
        elif e:
            w.cut(e, "i")
    if w.text.endswith(("enn", "onn", "ett", "ell", "eill")):
        w.cut("x")
    out = re.sub(f"[éè]([^{v}]+)$", r"e\1", w.text)
    return out.lower()


def _french_noun(w: Word) -> bool:
    """Whether an ending of nouns, adjectives or adverbs was cut, but for those after which verbs' endings are tried too."""
    groups = [
        FR_PLAIN, ["atrice", "ateur", "ation", "atrices", "ateurs", "ations"], ["logie", "logies"], ["usion", "ution", "usions", "utions"], ["ence", "ences"], ["ement", "ements"], ["ité", "ités"],
        ["if", "ive", "ifs", "ives"], ["eaux"], ["aux"], ["euse", "euses"], ["issement", "issements"], ["amment"], ["emment"], ["ment", "ments"],
    ]
    e = w.find(x for g in groups for x in g)
    k = next((i for i, g in enumerate(groups) if e in g), -1)
    before = w.text
    if k in (0, 1, 2, 3, 4, 6, 7) and not w.inside(e, w.r2):
        return False
    if k == 0:
        w.cut(e)
    elif k == 1:
        w.cut(e)
        if w.text.endswith("ic"):
            w.cut("ic", "" if w.inside("ic", w.r2) else "iqU")
    elif k in (2, 3, 4):
        w.cut(e, {2: "log", 3: "u", 4: "ent"}[k])
    elif k == 5 and w.inside(e, w.rv):
        w.cut(e)
        if w.text.endswith("iv"):
            if w.inside("iv", w.r2):
                w.cut("iv")
                w.drop(("at",), w.r2)
        elif w.text.endswith("eus"):
            if w.inside("eus", w.r2):
                w.cut("eus")
            elif w.inside("eus", w.r1):
                w.cut("eus", "eux")
        elif x := w.find(("abl", "iqU")):
            w.drop((x,), w.r2)
        elif (x := w.find(("ièr", "Ièr"))) and w.inside(x, w.rv):
            w.cut(x, "i")
    elif k == 6:
        w.cut(e)
        if w.text.endswith("abil"):
            w.cut("abil", "" if w.inside("abil", w.r2) else "abl")
        elif w.text.endswith("ic"):
            w.cut("ic", "" if w.inside("ic", w.r2) else "iqU")
        else:
            w.drop(("iv",), w.r2)
    elif k == 7:
        w.cut(e)
        if w.drop(("at",), w.r2) and w.text.endswith("ic"):
            w.cut("ic", "" if w.inside("ic", w.r2) else "iqU")
    elif k == 8:
        w.cut("x")
    elif k == 9 and w.inside(e, w.r1):
        w.cut(e, "al")
    elif k == 10:
        if w.inside(e, w.r2):
            w.cut(e)
        elif w.inside(e, w.r1):
            w.cut(e, "eux")
    elif k == 11 and w.inside(e, w.r1) and w.text[: -len(e)][-1:] not in ("", *w.vowels):
        w.cut(e)
    elif k in (12, 13) and w.inside(e, w.rv):
        w.cut(e, "ant" if k == 12 else "ent")
    elif k == 14 and w.text[: -len(e)][-1:] in tuple(w.vowels) and w.inside("x" + e, w.rv):
        w.cut(e)
    return w.text != before and k not in (12, 13, 14)


def _french_i(w: Word) -> bool:
    e = w.find(FR_I, w.rv)
    if e and w.inside("x" + e, w.rv) and w.text[: -len(e)][-1] not in w.vowels:
        w.cut(e)
        return True
    return False


def italian(word: str) -> str:
    v = "aeiouàèìòù"
    t = word.translate(str.maketrans("áéíóú", "àèìòù")).replace("qu", "qU")
    t = re.sub(f"(?<=[{v}])([ui])(?=[{v}])", lambda m: m[1].upper(), t)
    w = Word(t, v)
    w.rv = w.romance_rv()
    p = w.find(IT_PRONOUNS)
    if p and w.inside(p, w.rv):
        base = w.text[: -len(p)]
        if base.endswith(("ando", "endo")) and len(base) - 4 >= w.rv:
            w.cut(p)
        elif base.endswith(("ar", "er", "ir")) and len(base) - 2 >= w.rv:
            w.cut(p, "e")
    before = w.text
    verb_like = ["azione", "azioni", "atore", "atori"]
    abstract = {"logia": "log", "logie": "log", "uzione": "u", "uzioni": "u", "usione": "u", "usioni": "u", "enza": "ente", "enze": "ente"}
    e = w.find([*IT_PLAIN, *verb_like, *abstract, "amento", "amenti", "imento", "imenti", "amente", "ità", "ivo", "ivi", "iva", "ive"])
    if e == "amente":
        if w.inside(e, w.r1):
            w.cut(e)
            if w.text.endswith("iv"):
                if w.drop(("iv",), w.r2):
                    w.drop(("at",), w.r2)
            else:
                w.drop(("os", "ic", "abil"), w.r2)
    elif e in ("amento", "amenti", "imento", "imenti"):
        w.drop((e,), w.rv)
    elif e and w.inside(e, w.r2):
        w.cut(e, abstract.get(e, ""))
        if e in verb_like:
            w.drop(("ic",), w.r2)
        elif e == "ità":
            w.drop(("abil", "ic", "iv"), w.r2)
        elif e[:2] == "iv" and w.drop(("at",), w.r2):
            w.drop(("ic",), w.r2)
    if w.text == before and (e := w.find(IT_VERBS, w.rv)):
        w.cut(e)
    if w.drop("aeioàèìò", w.rv):
        w.drop(("i",), w.rv)
    if w.text.endswith(("ch", "gh")) and w.inside("h", w.rv):
        w.cut("h")
    return w.text.lower()


def portuguese(word: str) -> str:
    w = Word(word.replace("ã", "a~").replace("õ", "o~"), "aeiouáéíóúâêô")
    w.rv = w.romance_rv()
    before = w.text
    abstract = {"logia": "log", "logias": "log", "uça~o": "u", "uço~es": "u", "ência": "ente", "ências": "ente"}
    e = w.find([*PT_PLAIN, *abstract, "amente", "mente", "idade", "idades", "iva", "ivo", "ivas", "ivos", "ira", "iras"])
    if e == "amente":
        if w.inside(e, w.r1):
            w.cut(e)
            if w.text.endswith("iv"):
                if w.drop(("iv",), w.r2):
                    w.drop(("at",), w.r2)
            else:
                w.drop(("os", "ic", "ad"), w.r2)
    elif e in ("ira", "iras"):
        if w.inside(e, w.rv) and w.text[: -len(e)].endswith("e"):
            w.cut(e, "ir")
    elif e and w.inside(e, w.r2):
        w.cut(e, abstract.get(e, ""))
        if e == "mente":
            w.drop(("ante", "avel", "ível"), w.r2)
        elif e[:4] == "idad":
            w.drop(("abil", "ic", "iv"), w.r2)
        elif e[:2] == "iv":
            w.drop(("at",), w.r2)
    if w.text == before and (e := w.find(PT_VERBS, w.rv)):
        w.cut(e)
    if w.text != before:
        if w.text.endswith("ci") and w.inside("i", w.rv):
            w.cut("i")
    else:
        w.drop(("os", "a", "i", "o", "á", "í", "ó"), w.rv)
    if w.drop("eéê", w.rv):
        if w.text.endswith(("gu", "ci")) and w.inside("x", w.rv):
            w.cut("x")
    elif w.text.endswith("ç"):
        w.cut("ç", "c")
    return w.text.replace("a~", "ã").replace("o~", "õ")


def dutch(word: str) -> str:
    v = "aeiouyè"
    t = word.translate(str.maketrans("äëïöüáéíóú", "aeiouaeiou"))
    t = re.sub(f"^y|(?<=[{v}])y", "Y", t)
    t = re.sub(f"(?<=[{v}])i(?=[{v}])", "I", t)
    w = Word(t, v)
    w.r1 = max(3, w.r1)

    def undouble() -> None:
        if w.text.endswith(("kk", "dd", "tt")):
            w.cut("x")

    def en(ending: str) -> None:
        base = w.text[: len(w.text) - len(ending)]
        if w.inside(ending, w.r1) and base and base[-1] not in v and not base.endswith("gem"):
            w.cut(ending)
            undouble()

    def final_e() -> bool:
        if w.text.endswith("e") and w.inside("e", w.r1) and w.text[-2:-1] not in ("", *v):
            w.cut("e")
            undouble()
            return True
        return False

    e = w.find(("heden", "en", "ene", "s", "se"))
    if e == "heden":
        if w.inside(e, w.r1):
            w.cut(e, "heid")
    elif e in ("en", "ene"):
        en(e)
    elif e and w.inside(e, w.r1) and w.text[: -len(e)][-1:] not in ("", "j", *v):
        w.cut(e)
    gone = final_e()
    if w.text.endswith("heid") and w.inside("heid", w.r2) and not w.text.endswith("cheid"):
        w.cut("heid")
        if w.text.endswith("en"):
            en("en")
    e = w.find(("end", "ing", "ig", "lijk", "baar", "bar"))
    if e and w.inside(e, w.r2):
        if e in ("end", "ing"):
            w.cut(e)
            if w.text.endswith("ig") and w.inside("ig", w.r2) and not w.text.endswith("eig"):
                w.cut("ig")
            else:
                undouble()
        elif e == "ig":
            if not w.text.endswith("eig"):
                w.cut(e)
        elif e == "lijk":
            w.cut(e)
            final_e()
        elif e == "baar" or gone:
            w.cut(e)
    m = re.search(f"[^{v}](aa|ee|oo|uu)[^{v}I]$", w.text)
    if m:
        w.text = w.text[:-2] + w.text[-1]
    return w.text.lower()


def russian(word: str) -> str:
    v = "аеиоуыэюя"
    w = Word(word.replace("ё", "е"), v)
    w.rv = next((i + 1 for i, c in enumerate(w.text) if c in v), len(w.text))

    def cut(after_a: list[str], free: list[str]) -> bool:
        """Cuts the longest ending; those of the first list only after а or я, which stay."""
        e = w.find([*after_a, *free], w.rv)
        if e and (e in free or w.inside("x" + e, w.rv) and w.text[: -len(e)][-1] in "ая"):
            w.cut(e)
            return True
        return False

    if not cut(RU_GERUND_A, RU_GERUND):
        e = w.find(("ся", "сь"), w.rv)
        if e:
            w.cut(e)
        if cut([], RU_ADJECTIVE):
            cut(RU_PARTICIPLE_A, RU_PARTICIPLE)
        elif not cut(RU_VERB_A, RU_VERB):
            cut([], RU_NOUN)
    if w.text.endswith("и") and w.inside("и", w.rv):
        w.cut("и")
    e = w.find(("ост", "ость"))
    if e and w.inside(e, max(w.r2, w.rv)):
        w.cut(e)
    e = w.find(("ейш", "ейше", "нн", "ь"), w.rv)
    if e in ("ейш", "ейше"):
        w.cut(e)
        if w.text.endswith("нн") and w.inside("нн", w.rv):
            w.cut("н")
    elif e:
        w.cut("н" if e == "нн" else "ь")
    return w.text

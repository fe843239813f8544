"""Problem 8: personal information in free text, found and replaced by typed placeholders.

Method (skip-chain conditional random field): the nodes of a document are its capitalised words and the
chunks that have the form of an e-mail address, a number or a street address. Chain edges join words
that stand side by side, skip edges join distant nodes that repeat or resemble each other (the same
word, the same digits, a word and the local part of an address). Loopy message passing over all edges
makes the labels of a document consistent; a node gets the label of its largest marginal.

Training (piecewise, as published for skip-chain fields): node weights by logistic regression on hashed
context and form features of a bounded sample, whose labels come from the list of given names and from
cue words; edge potentials from the labels' agreement along the edges of the same sample. The model has
a fixed size, whatever the corpus. Decoding is one narrow Arrow map over whole texts.
"""

from __future__ import annotations

import re
import unicodedata
import warnings
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most documents that the model is fitted on, chosen by the hash of their id and read as a whole.
SAMPLE_DOCS = 2000
#: Most given names and makers that the model takes in; longer lists are refused.
LIST_ROWS = 100_000
#: Size of the hashed weight vectors.
BUCKETS = 1 << 16
#: Messages keep DAMPING of their old value; a document is done when none of its messages moves further than TOLERANCE. After ROUNDS a warning tells how many aren't.
DAMPING, TOLERANCE, ROUNDS = 0.3, 0.01, 200
#: Added to the log-odds of a person: a name missed costs more than a word masked.
PERSON_SHIFT = 1.0
#: Added besides for a word behind an initial, and half of it behind "M.", which may be a title.
INITIAL_SHIFT = 1.5

_CAP = r"[A-ZÀ-ÖØ-Þ][\wß-öø-ÿ]*(?:['’\-][A-ZÀ-ÖØ-Þ]?[\wß-öø-ÿ]+)*"
_CAPS = rf"{_CAP}(?: {_CAP}){{0,2}}"
# Words that make a street, by language.
_STREET_EN = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Way|Court|Ct|Boulevard|Blvd|Place|Pl|Square|Sq|Terrace|Close|Crescent|Row|Walk|Hill|Parkway|Highway)"
_STREET_DE = r"(?:[Ss]traße|[Ss]trasse|[Ss]tr\.|[Gg]asse|[Ww]eg|[Rr]ing|[Pp]latz|[Aa]llee|[Uu]fer|[Dd]amm|[Gg]raben|[Mm]arkt|[Ss]teig|[Cc]haussee)"
_STREET_FR = r"(?:rue|avenue|boulevard|chemin|allée|place|impasse|quai|route|cours|square|passage)"
_STREET_ES = r"(?:Calle|C/|Avenida|Avda\.?|Av\.|Paseo|Plaza|Camino|Ronda|Carrera|Travesía|Callejón)"
_LINK = r"(?:(?:de la|de los|de las|de l['’]|des|del|du|de|la|le|los|las) ?)?"
_ADDITION = r"(?:,? (?:Apt|Apartment|Suite|Unit|Flat|Floor|App|Piso|Hinterhaus|Bldg)\.? ?\d*\w?)?"
_DOMAIN = r"[A-Za-z0-9][\w\-]*(?:\.[A-Za-z0-9][\w\-]*)*\.[A-Za-z]{2,}"

_EMAIL = rf"(?P<email>(?<![A-Za-z0-9])[A-Za-z0-9][\w.+\-]* ?(?:@|＠|\(at\)|\[at\]|\(@\)|\{{at\}}) ?{_DOMAIN}|(?<![A-Za-z0-9])[A-Za-z0-9][\w.+\-]* at [A-Za-z0-9][\w\-]*(?: dot [A-Za-z0-9][\w\-]*)+)"
_ADDRESS = (
    rf"(?P<address>\b\d{{1,5}}[A-Z]? {_CAPS} {_STREET_EN}\b(?:(?<=St)\.(?=\W))?{_ADDITION}"
    rf"|\b\d{{1,4}} ?(?:bis|ter|quater|[a-zA-Z])?,? {_STREET_FR} {_LINK}{_CAPS}"
    rf"|(?:\b{_CAP} )?\b(?:(?=[A-ZÄÖÜ][\wßäöü\-]*\.? \d)[A-ZÄÖÜ][\wßäöü\-]*?{_STREET_DE}|(?:Alte|Neue|Große|Kleine|Obere|Untere|Am|An der|Im|Zum|Zur|Auf der|In der) {_CAP}) \d{{1,4}} ?[a-z]?\b(?:\s?[-/–]\s?\d{{1,3}}[a-z]?)?"
    rf"|(?:\b|(?<=\s)){_STREET_ES} {_LINK}{_CAPS},? (?:nº|n°|n\.º|núm\.|No\.)? ?\d{{1,4}} ?[a-z]?\b(?:-\d+)?)"
)
_NUMBER = r"(?P<number>(?P<digits>\+?\(?\d+(?:(?:\) ?| \(|[ ./\-‑])\d+)+(?:-[A-Z]\b)?)|\+\d{8,14}|\b[A-Z]{1,3}\d{5,9}[A-Z]?\b|\b[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-Z]\b|\b\d{7,12}(?:-?[A-Z])?\b)"
# a letter right behind a number or a degree sign is a unit, not an initial
_WORD = rf"(?P<word>\b(?:(?<![\d°])(?<![\d°] )[A-Z]\.(?= ?[A-Z])|{_CAP}))"
#: Everything but an e-mail address begins with one of these.
_FIRST = r"(?=[0-9+(A-ZÀ-ÖØ-Þ])"
#: Without one of these a text holds no e-mail address.
_AT = ("@", "＠", " dot ", "(at)", "[at]", "{at}")
_CHUNKS = {at: re.compile("|".join([*[_EMAIL][: int(at)], _FIRST + "(?:" + "|".join([_ADDRESS, _NUMBER, _WORD]) + ")"])) for at in (False, True)}


def _chunks(text: str) -> re.Pattern:
    """The pattern of all chunks, without the alternative that can't occur in the text."""
    return _CHUNKS[any(x in text for x in _AT)]


# Words before numbers of persons, before telephone numbers, and before other numbers.
ID_CUE = re.compile(r"(?i)(?:passport|reisepass|passeport|pasaporte|identity card|id card|ausweis|dni|nie|social|insurance|sociale|ssn|nino|ni number|tax|steuer\S*|fiscal|nif|nss|身份证|护照)(?: (?:no|number|nr|id|file no|file|card|security number|insurance no|security))?\s?[.:]*\s*$|(?i:ausweis-nr\.|n° de sécurité sociale|social security number) *$")
PHONE_CUE = re.compile(r"(?i)(?:tel\.?|telephone|phone|mobile|fax|call|text me on|number|numéro :|teléfono|telefonisch|unter|电话|or|oder|reach me at)\s*:?\s*$")
OTHER_CUE = re.compile(r"(?i)(?:sku|serial|order|ticket|lot|badge|pcn|charge|auftrag|batch|invoice|part|reel|page|rev|version|shot|rack|unit|start|log:|#)\s*[#:]?\s*$|[\d;#/_\-]$")
PARTICLES = {"van", "von", "de", "der", "den", "del", "della", "di", "da", "du", "la", "le", "ten", "ter", "dos", "zu", "af", "el", "bin", "ibn"}
TITLES = {"dr", "herr", "frau", "mr", "mrs", "ms", "prof", "mme", "mlle", "monsieur", "madame", "señor", "señora", "sr", "sra", "ing", "dipl"}
# Words before a name that address it; a comma behind the name doesn't turn it round.
GREETINGS = {"hello", "hi", "dear", "hallo", "hola", "bonjour", "liebe", "lieber", "as"}
# Words that open a sentence or name a document and are never a name.
NO_NAMES = set(
    "i hello hi dear hallo hola bonjour liebe lieber guten sehr geehrte geehrter cher chère estimado estimada buenos buenas as met ask call contact from to cc the and for by if at in on id "
    "quoted please thanks thank regards best kind sincerely merci cordialement saludos gracias gruß grüße update note also invoice site courier return text my you we has your our "
    "steuernummer steuer-id ni nino ssn dni nie nif personalausweis ausweis ausweis-nr reisepass passport pasaporte passeport tel fax mail email".split()
)
LABELS = {"email": ("", "email", ""), "address": ("", "address", ""), "number": ("", "phone", "id_number"), "word": ("", "person", "")}
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in ("email", "phone", "id_number", "address", "person")}
_BEFORE = re.compile(r"(\S+)?[ \t]*(\n)?(\S+)?[ \t]*$")
_AFTER = re.compile(r"[ \t]*(\n)?(\S+)?[ \t]*(\S+)?")


@lru_cache(100_000)
def folded(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if c.isalnum())


@dataclass
class Node:
    kind: str
    start: int
    end: int
    text: str
    before: tuple[str, str]
    after: tuple[str, str]
    line_start: bool


def nodes_of(text: str) -> list[Node]:
    out = []
    for m in _chunks(text).finditer(text):
        kind, (s, e) = m.lastgroup, m.span()
        # short groups of digits are measurements, dates and the like; a number with letters before it has its own form
        if kind == "number" and m["digits"] and sum(map(str.isdigit, m.group())) < 7:
            continue
        p = text[max(0, s - 40) : s]
        words = p.split()
        # a line break counts as a word of its own
        broken = s == 0 or p[len(p.rstrip(" \t")) - 1 : len(p.rstrip(" \t"))] == "\n"
        b1 = "\n" if broken else (words[-1] if words else "")
        b2 = words[-1] if broken and words else words[-2] if len(words) > 1 else ""
        q = text[e : e + 32]
        later = q.split()
        a1 = "\n" if q.lstrip(" \t")[:1] in ("\n", "\r") or not q else ((later[0] if later else "") if q[:1].isspace() else (later[0] if later else ""))
        if q and not q[:1].isspace():
            a1 = "+" + a1
        out.append(Node(kind, s, e, m.group(), (b1, b2), (a1, later[1] if len(later) > 1 else ""), broken))
    return out


def _shape(text: str) -> str:
    return re.sub(r"[^\W\d_]", "A", re.sub(r"\d", "9", text))


@lru_cache(100_000)
def _look(word: str) -> str:
    """The word's shape with runs made one, such as Aa, A. or 9/9."""
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[a-zß-öø-ÿ]", "a", re.sub(r"[A-ZÀ-ÖØ-Þ]", "A", re.sub(r"\d", "9", word))))[:12]


# A node's features in four groups: what stands before it, what stands behind it, both, and its own form. Each group
# depends on few strings, so that its weights are summed once for all nodes that share it.


def _before(kind: str, before: tuple[str, str]) -> list[str]:
    b1, b2 = before[0].lower(), before[1].lower()
    f = ["b1=" + b1, "b2=" + b2 + " " + b1]
    if kind == "number":
        return ["#" + x for x in f]
    look = _look(before[0])
    return [*f, "bs=" + look, "bbs=" + b2 + "|" + look, "title" if b1.rstrip(".") in TITLES else "no"]


def _after(kind: str, after: tuple[str, str]) -> list[str]:
    a1, a2 = after[0].lower(), after[1].lower()
    f = ["a1=" + a1, "a2=" + a1 + " " + a2]
    return ["#" + x for x in f] if kind == "number" else [*f, "as=" + _look(after[0])]


def _around(kind: str, both: tuple[str, str]) -> list[str]:
    f = "ba=" + both[0].lower() + "|" + both[1].lower()
    return ["#" + f] if kind == "number" else [f, "bas=" + _look(both[0]) + "|" + _look(both[1])]


def _form(kind: str, text: str, given: frozenset[str], full: bool) -> list[str]:
    """Features of the word or number itself; full adds those of a word's letters."""
    if kind == "number":
        shape = _shape(text)
        return ["shape=" + shape, "n=" + str(shape.count("9")), "plus=" + text[:1]]
    f = ["up" if text.isupper() and len(text) > 2 else "initial" if len(text) == 2 and text[1] == "." else "digit" if any(map(str.isdigit, text)) else "cap", "len=" + str(min(len(text), 9))]
    if full:
        low = text.lower()
        f += ["given" if low in given else "other", "w=" + low, "s3=" + low[-3:], "s4=" + low[-4:], "s5=" + low[-5:], "p3=" + low[:3]]
    return f


class Scorer:
    """Sums of weights of nodes, group by group; each group's sum is kept for the nodes that share it."""

    #: Entries kept of each group; only speed depends on it.
    KEPT = 200_000

    def __init__(self, given: frozenset[str], weights: np.ndarray | None = None, full: bool = True):
        self.given, self.weights, self.full = given, weights, full
        self.kept: tuple[dict, ...] = ({}, {}, {}, {})

    def _group(self, g: int, kind: str, key):
        kept = self.kept[g]
        found = kept.get((kind, key))
        if found is None:
            features = _form(kind, key, self.given, self.full) if g == 3 else (_before, _after, _around)[g](kind, key)
            found = [zlib.crc32(f.encode()) % BUCKETS for f in features]
            if self.weights is not None:
                found = self.weights[:, found].sum(axis=1)
                found = float(found[0]) if kind == "word" else found[1:]
            if len(kept) >= self.KEPT:
                kept.clear()
            kept[kind, key] = found
        return found

    def __call__(self, n: Node):
        """The node's sum (of a word for a person; of a number for a phone and an id), or its features' places if there are no weights."""
        kind = n.kind
        return self._group(0, kind, n.before) + self._group(1, kind, n.after) + self._group(2, kind, (n.before[0], n.after[0])) + self._group(3, kind, n.text)


def _fit(rows: list[list[int]], y: np.ndarray, weight: np.ndarray, passes: int = 100, ridge: float = 2e-4) -> np.ndarray:
    """Logistic regression on hashed binary features by full-batch adaptive gradient steps; the last weight is the bias."""
    length = np.array([len(r) for r in rows])
    flat = np.concatenate(rows).astype(np.intp)
    first = np.r_[0, np.cumsum(length)[:-1]]
    w, bias, square, square_bias = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(passes):
        z = np.add.reduceat(w[flat], first) + bias
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        grad = np.bincount(flat, np.repeat(g, length), BUCKETS) / len(rows) + ridge * w
        square += grad**2
        w -= 0.5 * grad / np.sqrt(square)
        gb = g.mean()
        square_bias += gb**2
        bias -= 0.5 * gb / np.sqrt(square_bias)
    return np.append(w, bias)


def chain_pairs(nodes: list[Node], text: str) -> list[tuple[int, int]]:
    """Words that stand side by side: with a blank, a particle, or a comma and a blank between them."""
    out = []
    for i in range(len(nodes) - 1):
        a, b = nodes[i], nodes[i + 1]
        if a.kind == b.kind == "word" and b.start - a.end <= 12:
            between = text[a.end : b.start]
            # "M." is a title as often as an initial: it tells nothing of its neighbour's label
            if "," in between and a.before[0].lower() in GREETINGS:
                continue
            if a.text == "M." or a.text.lower() in NO_NAMES or b.text.lower() in NO_NAMES:
                continue
            if between in (" ", ", ", "") or (between.strip() in PARTICLES and "\n" not in between) or all(x in PARTICLES for x in between.split()) and between.strip():
                out.append((i, i + 1))
    return out


def skip_pairs(nodes: list[Node]) -> list[tuple[int, int]]:
    """Distant nodes that repeat or resemble each other, each joined to the last one before: as many edges as nodes."""
    last: dict[str, int] = {}
    out = []
    for i, n in enumerate(nodes):
        if n.kind == "word":
            keys = {k for k in map(folded, re.split(r"[-’']", n.text)) if len(k) > 2}
        elif n.kind == "number":
            keys = {re.sub(r"\D", "", n.text)}
        elif n.kind == "email":
            keys = {k for k in re.split(r"[._+\-\d]+", re.split(r"@|＠|\(| at |\[", n.text)[0].strip().lower()) if len(k) > 3}
        else:
            keys = {n.text.lower()}
        for k in keys:
            j = last.get(k)
            if j is not None and j != i:
                out.append((j, i))
            last[k] = i
    return out


@dataclass
class Model:
    """weights: of persons, phones and id numbers; edges: log-potentials of agreement along chain and skip edges."""

    person: np.ndarray
    phone: np.ndarray
    identity: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    given: frozenset[str]
    makers: frozenset[str]

    def scorer(self) -> Scorer:
        return Scorer(self.given, np.stack([self.person[:-1], self.phone[:-1], self.identity[:-1]]))


def _log_potential(pairs: Counter) -> np.ndarray:
    """Pointwise mutual information of the two binary labels of an edge, smoothed."""
    table = np.array([[pairs[a, b] + 1.0 for b in (0, 1)] for a in (0, 1)])
    p = table / table.sum()
    return np.clip(np.log(p / np.outer(p.sum(1), p.sum(0))), -2.5, 2.5)


def words_of(names: list[str]) -> frozenset[str]:
    return frozenset(w for n in names for w in re.findall(r"\w{3,}", n.lower()))


def train(texts: list[str], given_names: list[str], makers: frozenset[str] = frozenset()) -> Model:
    """A model from sample texts without labels and the list of given names; makers are words that are never names. Deterministic."""
    given = frozenset(g.lower() for g in given_names)
    docs = [(t, nodes_of(t)) for t in texts]
    words = [(d, i) for d, (_, ns) in enumerate(docs) for i, n in enumerate(ns) if n.kind == "word"]
    place = {x: k for k, x in enumerate(words)}
    seed = np.array([docs[d][1][i].text.lower() in given for d, i in words], dtype=float)
    beside = seed.copy()
    chains = [[(place[d, i], place[d, j]) for i, j in chain_pairs(ns, t)] for d, (t, ns) in enumerate(docs)]
    barred = np.array([docs[d][1][i].text.lower().rstrip(".") in NO_NAMES | TITLES | makers or sum(map(str.isdigit, docs[d][1][i].text)) > 1 for d, i in words], dtype=bool)
    for pairs in chains:
        for a, b in pairs:
            # over a comma only a surname before a given name counts
            (d, i), (_, j) = words[a], words[b]
            comma = "," in docs[d][0][docs[d][1][i].end : docs[d][1][j].start]
            beside[a], beside[b] = max(beside[a], seed[b]), max(beside[b], 0.0 if comma else seed[a])
    beside[barred] = 0.0
    # first on contexts alone: names that the list lacks stand in the same contexts as those it has
    places = Scorer(given, full=False)
    context = [places(docs[d][1][i]) for d, i in words]
    if len(words) and 0 < seed.sum() < len(seed):
        first = _fit(context, beside, np.where(beside > 0, 2.0, 1.0))
        z = np.array([first[r].sum() for r in context]) + first[-1]
        label = np.where(barred, 0.0, np.maximum(beside, z > -0.5))
        # a word beside a name is one too
        for d, pairs in enumerate(chains):
            for a, b in pairs:
                if "," not in docs[d][0][docs[d][1][words[a][1]].end : docs[d][1][words[b][1]].start]:
                    label[a], label[b] = (0.0 if barred[k] else max(label[a], label[b]) for k in (a, b))
        # a type of word that mostly stands elsewhere is no name, however it stands once
        by_type: dict[str, list[float]] = {}
        for k, (d, i) in enumerate(words):
            by_type.setdefault(docs[d][1][i].text.lower(), []).append(label[k])
        def common(k: int) -> bool:
            d, i = words[k]
            stands = by_type[docs[d][1][i].text.lower()]
            return len(stands) > 3 and not seed[k] and docs[d][1][i].text[-1] != "." and np.mean(stands) < 0.3

        label = np.where([common(k) for k in range(len(words))], 0.0, label)
        places = Scorer(given)
        rows = [places(docs[d][1][i]) for d, i in words]
        person = _fit(rows, label, np.ones(len(words)))
        # once more, with what the words' own forms say
        z = np.array([person[r].sum() for r in rows]) + person[-1]
        label = np.where(barred, 0.0, np.maximum(beside, z > 0.0))
        person = _fit(rows, label, np.ones(len(words)))
    else:
        label, person = np.zeros(len(words)), np.append(np.zeros(BUCKETS), -3.0)
    chain: Counter = Counter((int(label[a]), int(label[b])) for pairs in chains for a, b in pairs)
    skip: Counter = Counter()
    for d, (_, ns) in enumerate(docs):
        for i, j in skip_pairs(ns):
            if (d, i) in place and (d, j) in place:
                skip[int(label[place[d, i]]), int(label[place[d, j]])] += 1
    rows, y, places = [], [], Scorer(given)
    for t, ns in docs:
        for n in ns:
            if n.kind == "number":
                p = t[max(0, n.start - 40) : n.start]
                kind = 2 if ID_CUE.search(p) else 0 if OTHER_CUE.search(p) else 1 if PHONE_CUE.search(p) or n.text[0] == "+" else -1
                if kind >= 0:
                    rows.append(places(n))
                    y.append(kind)
    kinds = np.array(y)
    weak = np.append(np.zeros(BUCKETS), -3.0)
    phone = _fit(rows, (kinds == 1).astype(float), np.ones(len(y))) if rows and (kinds == 1).any() else weak
    identity = _fit(rows, (kinds == 2).astype(float), np.ones(len(y))) if rows and (kinds == 2).any() else weak
    f32 = lambda x: x.astype(np.float32)
    return Model(f32(person), f32(phone), f32(identity), _log_potential(chain), _log_potential(skip + Counter({(b, a): n for (a, b), n in skip.items()})), given, makers)


def infer(unary: np.ndarray, edges: np.ndarray, potential: np.ndarray) -> np.ndarray:
    """Beliefs (log, up to a constant) of nodes with three states by loopy belief propagation, all edges at once."""
    if not len(edges):
        return unary
    i, j = edges[:, 0], edges[:, 1]
    forth, back = np.zeros((len(edges), 3)), np.zeros((len(edges), 3))

    def send(cavity: np.ndarray, table: np.ndarray) -> np.ndarray:
        m = np.logaddexp.reduce(cavity[:, :, None] + table, axis=1)
        return m - m.max(axis=1, keepdims=True)

    # documents are apart from each other: the edges of those that have settled rest
    component = _components(len(unary), edges)
    moving = np.arange(len(edges))
    for _ in range(ROUNDS):
        belief = unary.copy()
        np.add.at(belief, j, forth)
        np.add.at(belief, i, back)
        a, b, table = i[moving], j[moving], potential[moving]
        new_forth, new_back = send(belief[a] - back[moving], table), send(belief[b] - forth[moving], table.transpose(0, 2, 1))
        moved = np.maximum(np.abs(new_forth - forth[moving]).max(axis=1), np.abs(new_back - back[moving]).max(axis=1))
        forth[moving], back[moving] = DAMPING * forth[moving] + (1 - DAMPING) * new_forth, DAMPING * back[moving] + (1 - DAMPING) * new_back
        most = np.zeros(component.max() + 1)
        np.maximum.at(most, component[a], moved)
        moving = moving[most[component[a]] > TOLERANCE]
        if not len(moving):
            break
    else:
        warnings.warn(f"{len(np.unique(component[i[moving]]))} groups of nodes haven't settled after {ROUNDS} rounds", stacklevel=2)
    belief = unary.copy()
    np.add.at(belief, j, forth)
    np.add.at(belief, i, back)
    return belief


def _components(n: int, edges: np.ndarray) -> np.ndarray:
    """For each of n nodes the number of its connected component."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges.tolist():
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[rb] = ra
    return np.array([root(x) for x in range(n)])


def mentions(texts: list[str | None], model: Model, own: list[str | None] | None = None, scorer: Scorer | None = None) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) of each text's mentions, in order, without overlaps; positions in code points. own: each document's maker."""
    score = scorer or model.scorer()
    lift, bias = float(model.person[-1]) + PERSON_SHIFT, np.array([model.phone[-1], model.identity[-1]])
    unary, edges, tables, parsed = [], [], [], []
    wide = lambda t: np.pad(t, ((0, 1), (0, 1)))
    potentials = np.array([wide(model.chain), wide(model.skip)])
    for text, maker in zip(texts, own or [None] * len(texts)):
        nodes = nodes_of(text) if text else []
        barred = model.makers | words_of([maker]) if maker else model.makers
        base = len(unary)
        for n in nodes:
            if n.kind == "word":
                t = n.text
                if t.lower() in barred or len(t) > 1 and sum(map(str.isdigit, t)) > 1:
                    unary.append((0.0, -20.0, -60.0))
                    continue
                z = score(n) + lift
                b = n.before[0]
                if len(b) == 2 and b[1] == "." and "A" <= b[0] <= "Z":
                    z += INITIAL_SHIFT / 2 if b == "M." else INITIAL_SHIFT
                unary.append((0.0, z, -60.0))
            elif n.kind == "number":
                z = score(n) + bias
                unary.append((0.0, float(z[0]), float(z[1])))
            else:
                unary.append((0.0, 5.0, -60.0))
        if nodes:
            chain, skip = chain_pairs(nodes, text), skip_pairs(nodes)
            edges += [(base + a, base + b) for a, b in chain] + [(base + a, base + b) for a, b in skip]
            tables += [0] * len(chain) + [1] * len(skip)
        parsed.append((base, nodes))
    beliefs = infer(np.array(unary).reshape(-1, 3), np.array(edges, dtype=np.int64).reshape(-1, 2), potentials[np.array(tables, dtype=np.int64)])
    best = beliefs.argmax(axis=1)
    return [_spans(text, nodes, best[base : base + len(nodes)]) for text, (base, nodes) in zip(texts, parsed)]


def _initials(text: str, nodes: list[Node], states: np.ndarray) -> np.ndarray:
    """States in which an initial before a name belongs to it, unless it is "M." as a title: where "a" and a verb follow the name."""
    states = states.copy()
    beside = lambda a, b: nodes[a].kind == nodes[b].kind == "word" and text[nodes[a].end : nodes[b].start] == " "
    for i in range(len(nodes) - 1, -1, -1):
        t = nodes[i].text
        if len(t) == 2 and t[1] == "." and nodes[i].kind == "word":
            k = i
            while k + 1 < len(nodes) and states[k + 1] == 1 and beside(k, k + 1):
                k += 1
            inside = i > 0 and states[i - 1] == 1 and beside(i - 1, i)
            title = t == "M." and not inside and text.startswith(" a ", nodes[k].end)
            states[i] = int(k > i and not title)
    return states


def _spans(text: str | None, nodes: list[Node], states: np.ndarray) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    states = _initials(text, nodes, states) if nodes else states
    i = 0
    while i < len(nodes):
        n = nodes[i]
        kind = LABELS[n.kind][int(states[i])]
        if not kind or n.kind == "word" and (n.text.lower() in NO_NAMES or n.text.rstrip(".").lower() in TITLES):
            i += 1
            continue
        start, end = n.start, n.end
        if kind == "person":
            # words of one mention: blanks, particles, and one comma between surname and given name
            k, commas = i + 1, 0
            while k < len(nodes) and nodes[k].kind == "word" and states[k] == 1 and nodes[k].text.rstrip(".").lower() not in TITLES:
                between = text[end : nodes[k].start]
                joined = between in (" ", "") or between.strip() and "\n" not in between and "," not in between and all(x in PARTICLES for x in between.split())
                if between == ", " and not commas and _turned(nodes[i:k]) and nodes[k].text.lower() not in NO_NAMES:
                    commas, joined = 1, True
                if not joined:
                    break
                end = nodes[k].end
                k += 1
            # a surname's particles before a comma form
            before = re.search(r"(?:\b(?:van|von|de|der|den|del) )+$", text[max(0, start - 16) : start])
            if before and commas:
                start -= len(before.group())
            i = k
        else:
            i += 1
        out.append((kind, start, end))
    return out


def _turned(run: list[Node]) -> bool:
    """Whether a comma behind the run can stand within one name, surname first: only one word, no initial, before it."""
    return len(run) == 1 and len(run[0].text) > 2 and run[0].before[0].lower() not in GREETINGS


def fit_model(docs: DataFrame, first_names: DataFrame, canon: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """The model from a bounded sample of docs (doc_id, text), chosen by hash, the list of given names and the makers of the reference list."""
    chosen = docs.filter("length(text) > 0").select("text", F.xxhash64("doc_id").alias("h"), "doc_id").orderBy("h", "doc_id").limit(sample_docs)
    lists = [first_names.filter("first_name is not null").select("first_name"), canon.filter("kind = 'mfr'").select("name", "aliases")]
    names, makers = ([tuple(r) for r in rows.limit(LIST_ROWS + 1).collect()] for rows in lists)
    if max(len(names), len(makers)) > LIST_ROWS:
        raise ValueError(f"the lists of given names and of makers may have {LIST_ROWS} rows at most")
    return train([r.text for r in chosen.collect()], [n for (n,) in names], words_of([n for name, aliases in makers for n in (name, *(aliases or [])) if n]))


def find_personal(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text, mentions array<struct<kind, start_pos, end_pos>>) for every row of docs (doc_id, text, mfr).

    Null and empty texts have no mentions; a null mfr bars no word; repeated rows are kept; other columns
    are ignored. Whole texts are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start_pos", pa.int64()), ("end_pos", pa.int64())]))
        for batch in batches:
            # slices keep the nodes that are in memory few, however long the texts
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = mentions(part.column(1).to_pylist(), model, part.column(2).to_pylist(), scorer)
                lists = [[{"kind": k, "start_pos": s, "end_pos": e} for k, s, e in f] for f in found]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lists, kind)], names=["doc_id", "text", "mentions"])

    return docs.select("doc_id", "text", "mfr").mapInArrow(run, "doc_id long, text string, mentions array<struct<kind: string, start_pos: long, end_pos: long>>")


def redact(found: DataFrame) -> DataFrame:
    """(doc_id, text): each mention replaced by its placeholder, the rest unchanged."""
    size = F.size("mentions")
    start_of = lambda i: F.try_element_at("mentions", i)["start_pos"]
    piece = lambda a, b: F.substr(F.col("text"), (a + 1).cast("int"), (b - a).cast("int"))
    names = F.create_map(*[F.lit(x) for kv in PLACEHOLDERS.items() for x in kv])
    parts = F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(names[F.try_element_at("mentions", i)["kind"]], piece(F.try_element_at("mentions", i)["end_pos"], F.coalesce(start_of(i + 1), F.length("text").cast("long")))))
    return found.select("doc_id", F.when(size > 0, F.concat(piece(F.lit(0), start_of(F.lit(1))), F.array_join(parts, ""))).otherwise(F.col("text")).alias("text"))

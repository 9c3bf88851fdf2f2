"""Personal data: patterns for numbers and addresses, and a linear-chain CRF over word shapes for names and streets.

Patterns find e-mail addresses, IP addresses, card and phone numbers. Names and street addresses have no pattern of their own:
a conditional random field, trained from a small labelled table, labels every word from independent features of its own and of its
neighbours (shape, list, ending, affixes, and the pair of shapes with the word before); a word with features that the table
doesn't have is still judged by the others. The best labelling comes from Viterbi over numpy batches, and each labelled stretch
becomes a span beside the pattern spans.

Words are cut at white space; a text is one chain of any length, in blocks between which best scores are carried. All patterns
take time linear in the text.

Defined cases: a null or empty text has no spans; equal rows get equal results; an empty table gives an empty table; a null id
is passed through. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusloom.llm.crf import chain_viterbi, train
from corpusloom.llm.texts import holds, map_rows, sha256, spans_text

#: Kinds in the order in which spans with equal starts are listed.
KINDS = {"email": 0, "ip": 1, "card": 2, "phone": 3, "name": 4, "street": 5}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
# Runs of digits are taken whole, so a later start within one can't match where its first digit didn't.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+ from left to right, found from each @."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, end := m.end()))
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    return found


def find(text: str) -> list[tuple[int, int, str]]:
    """start, end, kind of the pattern spans."""
    found = [(s, e, "email") for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return found


#: Words that announce a name or belong to a street address.
LISTS = {
    "title": "mr mrs ms miss dr prof sir madam herr frau monsieur madame mme señor señora sr sra don doña",
    "cue": "name named contact attn dear signed author patient employee customer nom nombre contacto kontakt call called regards sincerely",
    "by": "by from with to for and met saw is was",
    "street": "street st avenue ave road rd lane ln drive boulevard blvd court calle rue straße strasse weg platz avenida plaza",
    "place": "at lives live address resident resides moved located wohnt adresse habite dirección",
    "date": "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday",
    "common": "the a an of in on this that these it he she they we you i his her our your my and but or if when then there here not no all any some most many new der die das le la el un une una",
}
_LISTED = {word: name for name, words in LISTS.items() for word in words.split()}

#: The labelled table is made from these parts: each frame with names or streets in turn, and sentences without any.
FIRST = "John Anna Peter Laura Maria Wei Amara Ingrid Tom Klaus Julia Claire Pablo Elena Robert Susan Olivia Henry Fatima Yuki Omar Nadia Luca Sofia".split()
LAST = "Smith Keller Novak Bianchi Lopez Chen Okafor Larsen Becker Vogel Braun Dubois Ruiz Torres King Hall Grant Ford Haddad Tanaka Silva Petrov Rossi Doe".split()
NAME_FRAMES = (
    "Please contact {t} {f} {l} about the invoice .", "Dear {t} {l} , thank you for the letter .", "The report was signed by {f} {l} in May .", "Patient name: {f} {l} was seen on Monday .",
    "Contact: {f} {l} , sales department", "We met {t} {f} {l} at noon .", "Author: {f} {l} writes about trade .", "My name is {f} {l} and I work here .", "Employee: {f} {l} , desk nine .",
    "{t} {f} {l} was not in the office .", "signed: {f} {l}", "Attn: {f} {l}", "I saw {t} {l} yesterday .", "Regards , {f} {l}", "customer {f} {l} called again .", "The letter from {f} {l} is here .", "Nombre: {f} {l}", "Kontakt: {f} {l} , Büro",
    "Write to {t} {f} {l}, please .", "A talk with {f} {l} and others .",
)
TITLES = "Mr. Mrs. Dr. Ms. Prof. Herr Frau Madame Señor Señora".split()
ROADS = "Oak Market Hill Lake Rose King Ocean Church Mill River Station Elm Park High".split()
KINDS_OF_ROAD = "Street Road Avenue Lane Drive Boulevard St. Court".split()
STREET_FRAMES = (
    "She lives at {n} {r} {k} near the park .", "Our office moved to {n} {r} {k} last year .", "Send it to the address {n} {r} {k} today .", "The shop at {n} {r} {k} is closed .", "Address: {n} {r} {k}, second floor .",
    "Located at {n} {r} {k} by the sea .", "He resides at {n} {r} {k} .", "They found {n} {r} {k}. It was late .",
)
BOTH_FRAMES = ("Contact: {f} {l}, {n} {r} {k}", "Write to {t} {f} {l}, {n} {r} {k} today .", "{t} {f} {l} lives at {n} {r} {k} .")
OTHER_STREETS = ("habite [street 14 Rue Pasteur] depuis mars .", "vive en [street Calle Mayor 22] con su hermana .", "wohnt in [street Lange Straße 8] seit Mai .", "Die Firma sitzt in [street Alte Straße 101] heute .")
WITHOUT = (
    "Mr. and Mrs. of the house went out .", "The street was empty and the road was long .", "There are 12 apples and 40 pears on the table .", "The River runs through the Valley . Many People like it .",
    "All Rights Reserved by the Company in 2019 .", "Monday and Tuesday are free . Wednesday is not .", "New York and San Diego are large cities .", "The name of the rose is a book .", "Please contact us for more details .",
    "Dear customer , your order of 3 items is ready .", "He lives at home and works at night .", "Table 4 shows Results of Section 12 .", "The Doctor said that 20 percent are well .", "Der Herr ist nicht da . Die Frau liest .",
    "La calle es larga . El nombre es corto .", "La rue est longue et le nom est court .", "Version 2 of the License applies to all Files .", "THE END OF THE STORY IS NEAR .", "It was found. Then it was lost again. Nobody knew why.",
    "Words stand alone. Others follow. So it goes. Rain fell. Night came.", "address of the 2 servers is known .", "1 2 3 4 5 6 7 8 9 10", "Contact Information and Support Pages", "Name Address Phone Number Email", "Un Dos Tres son palabras . Eins Zwei Drei auch .",
    "The work is licensed by Creative Commons under a Public License .", "Written in Java and Python for Linux by volunteers .", "Chapter Three begins with Spring and ends with Winter .", "A letter from Paris and a call to London .", "He signed by hand and called by phone .",
    "The Big Book Of Small Things Is Here", "Große Häuser und kleine Straßen in Berlin .", "Les Jours et les Nuits de Paris .", "Los Días y las Noches de Madrid .", "Then came Summer. Summer was long. And Then Autumn .", "We met at Noon and left at Midnight .",
    "It is by Design and not by Chance .", "Open from Monday to Friday with Lunch at 12 .", "Section 5 Lane Departure Warning Systems", "In 1999 Street art was new .",
)


def labelled_table() -> tuple[str, ...]:
    """The sentences, spans in brackets: every frame with several fillings, dealt out in turn."""
    rows: list[str] = []

    def fill(frame: str, i: int) -> str:
        t, f, l = TITLES[i % len(TITLES)], FIRST[i * 5 % len(FIRST)], LAST[i * 7 % len(LAST)]
        frame = frame.replace("{t} {f} {l}", "[name {t} {f} {l}]").replace("{t} {l}", "[name {t} {l}]") if "{t}" in frame else frame.replace("{f} {l}", "[name {f} {l}]")
        frame = frame.replace("{n} {r} {k}", "[street {n} {r} {k}]")
        return frame.format(t=t, f=f, l=l, n=(i * 37 + 5) % 900 + 1, r=ROADS[i % len(ROADS)], k=KINDS_OF_ROAD[i % len(KINDS_OF_ROAD)])

    for frames, turns in ((NAME_FRAMES, 6), (STREET_FRAMES, 6), (BOTH_FRAMES, 4)):
        rows += [fill(frame, i * turns + j) for i, frame in enumerate(frames) for j in range(turns)]
    return (*rows, *OTHER_STREETS * 2, *WITHOUT * 2)


LABELLED = labelled_table()
LABELS = ("O", "B-name", "I-name", "B-street", "I-street")
#: Words whose scores a worker keeps in each of two generations, and letters in them.
KEPT, KEPT_LETTERS = 200_000, 4_000_000

_EDGE = ".,;:!?()[]\"'"


def role(word: str) -> str:
    """A word's list and shape, which pair with those of the word before."""
    bare = word.strip(_EDGE)
    kind = _LISTED.get(bare.lower(), "")
    if not bare:
        shape = "mark"
    elif bare.isdigit():
        shape = f"d{min(len(bare), 5)}"
    elif bare.isalpha():
        shape = "x" if bare.islower() else "X" if bare.isupper() else "Xx" if bare[0].isupper() and bare[1:].islower() else "xX"
    else:
        shape = "mixed"
    return f"{kind}|{shape}"


def features(word: str) -> list[str]:
    """What tells about a word by itself, each on its own."""
    return describe(word)[1]


def describe(word: str) -> tuple[str, list[str]]:
    """A word's role and features."""
    bare = word.strip(_EDGE)
    of = role(word)
    kind, _, shape = of.partition("|")
    end = word[-1] if word[-1:] in _EDGE and word else ""
    low = bare.lower()
    return of, [f"k{kind}", f"h{shape}", f"e{end}", f"kh{of}", f"he{shape}|{end}", f"p{low[:2]}", f"s{low[-3:]}", f"s{low[-2:]}", f"n{min(len(bare), 8)}", *([f"w{low}"] if kind else [])]


def parse(marked: str) -> tuple[list[str], list[int]]:
    """Words and labels of a labelled sentence."""
    words, labels = [], []
    glued = False
    for part in re.findall(r"\[(\w+) ([^\]]+)\]|([^\[]+)", marked):
        text = part[1] if part[0] else part[2]
        inside = text.split()
        if glued and inside and not text[0].isspace():  # a mark right behind a span belongs to its last word
            words[-1] += inside[0]
            inside = inside[1:]
        words += inside
        labels += [LABELS.index(("B-" if i == 0 else "I-") + part[0]) if part[0] else 0 for i in range(len(inside))]
        glued = bool(part[0])
    return words, labels


class Kept:
    """Scores [words, the word itself / the one before / after, labels] and roles of the words that a worker has met."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.letters = 0
        self.scores = np.zeros((1024, 3, len(LABELS)), dtype=np.float32)
        self.role = np.zeros(1024, dtype=np.int32)

    def add(self, words: list[str], scores: np.ndarray, roles: np.ndarray) -> None:
        base = len(self.index)
        while len(self.role) < base + len(words):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.role = np.concatenate([self.role, np.zeros_like(self.role)])
        self.scores[base : base + len(words)], self.role[base : base + len(words)] = scores, roles
        self.index.update(zip(words, range(base, base + len(words)), strict=True))
        self.letters += sum(map(len, words))


class Tagger:
    """Scores of words by their features, as the word itself, the one before and the one after, and of pairs of roles."""

    def __init__(self, labelled: tuple[str, ...]):
        sentences = [parse(x) for x in labelled]
        self.names: dict[str, int] = {}
        self.roles: dict[str, int] = {"": 0}
        types: dict[str, int] = {}
        for words, _ in sentences:
            for w in words:
                if w not in types:
                    types[w] = len(types)
                    self.roles.setdefault(role(w), len(self.roles))
                    for f in features(w):
                        self.names.setdefault(f, len(self.names))
        n, r, k, t = len(self.names), len(self.roles), len(LABELS), len(types)
        has = np.zeros((t + 1, n))  # the last row is no word
        for w, i in types.items():
            for f in features(w):
                has[i, self.names[f]] = 1
        of = np.array([*(self.roles[role(w)] for w in types), 0])
        lengths = np.array([len(words) for words, _ in sentences])
        ids = np.full((len(sentences), lengths.max() + 2), t, dtype=np.int64)
        gold = np.full((len(sentences), lengths.max()), -1, dtype=np.int64)
        for i, (words, labels) in enumerate(sentences):
            ids[i, 1 : len(words) + 1] = [types[w] for w in words]
            gold[i, : len(words)] = labels
        blocks = [(ids[:, 1:-1], 0), (ids[:, :-2], n), (ids[:, 2:], 2 * n)]
        pair = of[ids[:, :-2]] * r + of[ids[:, 1:-1]]
        inside = gold >= 0

        def emit(w: np.ndarray) -> np.ndarray:
            return sum((has @ w[base : base + n])[x] for x, base in blocks) + w[3 * n :][pair]

        def pull(slope: np.ndarray) -> np.ndarray:
            out = np.zeros((3 * n + r * r, k))
            for x, base in blocks:
                by_type = np.zeros((t + 1, k))
                np.add.at(by_type, x[inside], slope[inside])
                out[base : base + n] = has.T @ by_type
            np.add.at(out, 3 * n + pair[inside], slope[inside])
            return out

        weights, transitions = train(emit, pull, 3 * n + r * r, gold, lengths, k, 120, 0.1, 2e-4)
        for i, a in enumerate(LABELS):  # an inside label follows its own kind only
            for j, b in enumerate(LABELS):
                if b[0] == "I" and a[2:] != b[2:]:
                    transitions[i, j] = -1e4
        self.transitions = transitions.astype(np.float32)
        self.weights = weights[: 3 * n].reshape(3, n, k).astype(np.float32)
        self.by_name = np.concatenate([self.weights.transpose(1, 0, 2), np.zeros((1, 3, k), dtype=np.float32)])  # the last row: no known feature
        self.pair = weights[3 * n :].reshape(r, r, k).astype(np.float32)
        self.never = np.array([b[0] == "I" for b in LABELS])
        self.clear()

    def clear(self) -> None:
        self.old: Kept = Kept()
        self.young: Kept = Kept()

    def numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Rows of the words' scores. Unseen words are scored all at once."""
        if len(self.young.index) > KEPT or self.young.letters > KEPT_LETTERS:
            self.old, self.young = self.young, Kept()
        young, old = self.young, self.old
        index = young.index
        fresh = [w for w in dict.fromkeys(w for words in texts for w in words if w not in index)]
        known = [w for w in fresh if w in old.index]
        if known:
            at = np.fromiter(map(old.index.__getitem__, known), dtype=np.int64, count=len(known))
            young.add(known, old.scores[at], old.role[at])
            fresh = [w for w in fresh if w not in index]
        if fresh:
            flat: list[int] = []
            sizes, roles, get = [], [], self.names.get
            for w in fresh:
                of, said = describe(w)
                numbers = [i for i in map(get, said) if i is not None]
                flat += numbers or [len(self.names)]
                sizes.append(len(numbers) or 1)
                roles.append(self.roles.get(of, 0))
            ends = np.cumsum(sizes)
            young.add(fresh, np.add.reduceat(self.by_name[np.array(flat)], ends - sizes, axis=0), np.array(roles, dtype=np.int32))
        return [np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words)) for words in texts]

    def label(self, numbers: list[np.ndarray]) -> np.ndarray:
        """Labels of the words of all texts, end to end."""
        lengths = np.array([len(x) for x in numbers], dtype=np.int64)
        joined = np.concatenate(numbers) if numbers else np.zeros(0, dtype=np.int64)
        if not len(joined):
            return np.zeros(0, dtype=np.int8)
        ends = np.cumsum(lengths)
        firsts, lasts = (ends - lengths)[lengths > 0], (ends - 1)[lengths > 0]
        emissions = self.young.scores[joined, 0]
        emissions[1:] += self.young.scores[joined[:-1], 1]
        emissions[firsts[1:]] -= self.young.scores[joined[firsts[1:] - 1], 1]
        emissions[:-1] += self.young.scores[joined[1:], 2]
        emissions[lasts[:-1]] -= self.young.scores[joined[lasts[:-1] + 1], 2]
        roles = self.young.role[joined]
        before = np.concatenate([[0], roles[:-1]])
        before[firsts] = 0
        emissions += self.pair[before, roles]
        emissions[np.ix_(firsts, self.never)] -= 1e4
        return chain_viterbi(emissions, lengths, self.transitions)


@lru_cache(maxsize=2)
def tagger(labelled: tuple[str, ...]) -> Tagger:
    """Trained once on the driver; its size is fixed by the table."""
    return Tagger(labelled)


_WORD = re.compile(r"\S+")


def spans_of(text: str, labels: np.ndarray) -> list[tuple[int, int, str]]:
    """Labelled stretches as spans, without the punctuation around them."""
    found: list[tuple[int, int, str]] = []
    if not labels.any():
        return found
    words = [m.span() for m in _WORD.finditer(text)]
    hits = np.flatnonzero(labels)
    stretch: list[int] = []
    for i in [*hits.tolist(), -2]:
        if stretch and (i != stretch[-1] + 1 or LABELS[labels[i]][0] == "B"):
            start, end = words[stretch[0]][0], words[stretch[-1]][1]
            while end > start and text[end - 1] in _EDGE:
                end -= 1
            while start < end and text[start] in _EDGE:
                start += 1
            if end > start:
                found.append((start, end, LABELS[labels[stretch[0]]][2:]))
            stretch = []
        stretch.append(i)
    return found


COUNTED = ("email", "ip", "card", "phone")
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))


def scan_pii(docs: DataFrame, labelled: tuple[str, ...] = LABELLED, found_column: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_name, n_street; with found_column also found, the spans
    as an array."""
    schema = T.StructType(
        [
            docs.schema["doc_id"], *(T.StructField(f"n_{k}", T.LongType()) for k in COUNTED), T.StructField("base_sha256", T.StringType()),
            T.StructField("spans", T.StringType()), T.StructField("n_name", T.LongType()), T.StructField("n_street", T.LongType()),
            *([T.StructField("found", SPAN)] if found_column else []),
        ]
    )

    sent = docs.sparkSession.sparkContext.broadcast(tagger(labelled))

    def run(cols: dict[str, list]) -> dict[str, list]:
        model = sent.value
        holds("pii", model.clear)
        out: dict[str, list] = {"doc_id": cols["doc_id"]} | {f.name: [] for f in schema.fields[1:]}
        for i in range(0, len(cols["text"]), 250):
            texts = [t or "" for t in cols["text"][i : i + 250]]
            numbers = model.numbers([t.split() for t in texts])
            labels = model.label(numbers)
            at = 0
            for text, x in zip(texts, numbers, strict=True):
                base = find(text)
                more = spans_of(text, labels[at : at + len(x)])
                at += len(x)
                kinds = [k for _, _, k in base + more]
                text_of = spans_text(base, KINDS)
                for k in COUNTED:
                    out[f"n_{k}"].append(kinds.count(k))
                out["n_name"].append(kinds.count("name"))
                out["n_street"].append(kinds.count("street"))
                out["base_sha256"].append(sha256(text_of))
                out["spans"].append(spans_text(base + more, KINDS) if more else text_of)
                if found_column:
                    out["found"].append([{"start": s, "end": e, "kind": k} for s, e, k in base + more])
        return out

    return map_rows(docs.select("doc_id", "text"), run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return scan_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))

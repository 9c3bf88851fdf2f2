"""Language identification of words and documents with a linear-chain conditional random field.

Every word of a text is labelled with a language, so code-switched text gets its own label for each stretch. A word's
features are its affixes, its letter n-grams and its entry in a lexicon of training words; transitions between the labels of
neighbouring words are learned, from training chains that are put together from passages of several languages. Posteriors
come from forward-backward; a document's language is the one with the most expected words, its score their share.

Training reads a bounded sample: at most ``per_language`` documents of each language (the least hashes of their ids), and of
each at most ``PASSAGES`` passages of ``PASSAGE`` words, spread evenly over the whole text. Prediction reads all words of all
texts, each as one chain, in blocks between which messages are carried.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; rows without a language or id are predicted but
never trained on (a null id counts as not held out); with no training rows at all every document is ``und``; ties go to the
first language by name; equal texts get equal results; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.crf import chain_posteriors, train
from corpusloom.llm.texts import holds, map_rows

WORD = re.compile(r"[^\W\d_]+")
PER_LANGUAGE, PASSAGES, PASSAGE = 150, 6, 24
SALTS = 64
FEATURES, LEXICON, LEAST_SEEN = 1 << 16, 20_000, 3
#: Words whose emissions a worker keeps, and letters in them.
KEPT, KEPT_LETTERS = 200_000, 4_000_000


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def word_features(word: str, lexicon: frozenset[str]) -> list[int]:
    marked = f"<{word}>"
    names = [f"p{word[:i]}" for i in (1, 2, 3)] + [f"s{word[-i:]}" for i in (1, 2, 3)]
    names += [marked[i : i + n] for n in (2, 3) for i in range(len(marked) - n + 1)]
    if word in lexicon:
        names.append(f"l{word}")
    return [zlib.crc32(x.encode()) % FEATURES for x in names]


class Model:
    def __init__(self, labels: list[str], weights: np.ndarray, transitions: np.ndarray, lexicon: frozenset[str]):
        self.labels, self.weights, self.transitions, self.lexicon = labels, weights, transitions, lexicon


def _passages(cols: dict[str, list]) -> dict[str, list]:
    out = []
    for text in cols["text"]:
        words = [w.lower() for w in WORD.findall(text or "") if any(map(str.isalpha, w))]
        room = max(0, len(words) - PASSAGE)
        starts = sorted({room * i // (PASSAGES - 1) for i in range(PASSAGES)})
        out.append([" ".join(words[s : s + PASSAGE]) for s in starts if words])
    return {"doc_id": cols["doc_id"], "lang": cols["lang"], "passages": out}


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[str, list[str]]]:
    """(language, words) of the training passages: per_language * PASSAGES * PASSAGE words a language at most."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # the least hashes of each language in each of SALTS parts, then of those the least: no language's ids meet in one task
    ids = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("hash")).distinct().withColumn("part", F.pmod("hash", F.lit(SALTS)))
    for keys in (("lang", "part"), ("lang",)):
        first = Window.partitionBy(*keys).orderBy("hash", "doc_id")
        ids = ids.withColumn("turn", F.row_number().over(first)).where(F.col("turn") <= per_language).drop("turn")
    chosen = ids
    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang", T.StringType()), T.StructField("passages", T.ArrayType(T.StringType()))])
    # per_language rows a language, so of a bounded size
    texts = rows.select("doc_id", "lang", "text").join(F.broadcast(chosen.select("doc_id", "lang")), ["doc_id", "lang"], "left_semi")
    found = map_rows(texts.select("doc_id", "lang", "text"), _passages, schema).collect()
    return [(r["lang"], p.split(" ")) for r in sorted(found, key=lambda r: (r["lang"], str(r["doc_id"]), r["passages"])) for p in r["passages"] if p]


def fit(passages: list[tuple[str, list[str]]], rounds: int = 40) -> Model | None:
    """Train on chains of two passages each, mostly of different languages, so that transitions see both cases."""
    if not passages:
        return None
    labels = sorted({lang for lang, _ in passages})
    number = {lang: i for i, lang in enumerate(labels)}
    counts = Counter(w for _, words in passages for w in words)
    lexicon = frozenset(w for w, c in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LEXICON] if c >= LEAST_SEEN)
    chains = [passages[i] for i in np.random.default_rng(0).permutation(len(passages))]
    types = {w: i for i, w in enumerate(counts)}
    features = [word_features(w, lexicon) for w in types]
    sizes = np.array([len(x) for x in features])
    flat = np.concatenate([np.array(x) for x in features])
    owner = np.repeat(np.arange(len(types)), sizes)
    half = len(chains) // 2
    joined = [(a, b) for a, b in zip(chains[:half], chains[half:], strict=False)] + [(c,) for c in chains[2 * half :]]
    lengths = np.array([sum(len(words) for _, words in chain) for chain in joined])
    words = np.zeros((len(joined), lengths.max()), dtype=np.int64)
    gold = np.full(words.shape, -1, dtype=np.int64)
    for i, chain in enumerate(joined):
        at = 0
        for lang, part in chain:
            words[i, at : at + len(part)] = [types[w] for w in part]
            gold[i, at : at + len(part)] = number[lang]
            at += len(part)
    inside = gold >= 0

    def emit(weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weights[flat], np.cumsum(sizes) - sizes, axis=0)[words]

    def pull(slope: np.ndarray) -> np.ndarray:
        out = np.empty((FEATURES, len(labels)))
        for k in range(len(labels)):
            of_type = np.bincount(words[inside], weights=slope[inside][:, k], minlength=len(types))
            out[:, k] = np.bincount(flat, weights=of_type[owner], minlength=FEATURES)
        return out

    weights, transitions = train(emit, pull, FEATURES, gold, lengths, len(labels), rounds, 0.1, 1e-6)
    return Model(labels, weights.astype(np.float32), transitions.astype(np.float32), lexicon)


class Tagger:
    """Emissions of the words a worker has met, kept up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.letters = 0
        self.rows = np.zeros((1024, len(self.model.labels)), dtype=np.float32)

    def numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.index) > KEPT or self.letters > KEPT_LETTERS:
            self.clear()
        index = self.index
        fresh = [w for w in dict.fromkeys(w for words in texts for w in words if w not in index)]
        if fresh:
            features = [word_features(w.lower(), self.model.lexicon) for w in fresh]
            sizes = np.array([len(x) for x in features])
            emitted = np.add.reduceat(self.model.weights[np.concatenate([np.array(x) for x in features])], np.cumsum(sizes) - sizes, axis=0)
            base = len(index)
            while len(self.rows) < base + len(fresh):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[base : base + len(fresh)] = emitted
            index.update(zip(fresh, range(base, base + len(fresh)), strict=True))
            self.letters += sum(map(len, fresh))
        return [np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words)) for words in texts]

    def posteriors(self, numbers: list[np.ndarray]) -> np.ndarray:
        """[words of all texts, labels], texts end to end."""
        lengths = np.array([len(x) for x in numbers], dtype=np.int64)
        joined = np.concatenate(numbers) if numbers else np.zeros(0, dtype=np.int64)
        return chain_posteriors(self.rows[joined], lengths, self.model.transitions)


_TAGGERS: dict[int, Tagger] = {}


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_words, n_switches (neighbouring words with different labels) per text."""
    spark = docs.sparkSession
    schema = T.StructType(
        [
            docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()), T.StructField("n_words", T.LongType()), T.StructField("n_switches", T.LongType()),
        ]
    )
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_rows(rows, labeller(spark, model), schema)


def portions(texts: list[list[str]], most: int = 200_000) -> Iterator[list[list[str]]]:
    """The texts in turn, as many together as hold so many words (a longer text alone)."""
    part, n = [], 0
    for text in texts:
        if part and n + len(text) > most:
            yield part
            part, n = [], 0
        part.append(text)
        n += len(text)
    if part:
        yield part


def labeller(spark, model: Model | None, words: bool = False):
    """words: with labels, the label of every word."""
    sent = spark.sparkContext.broadcast(model)  # of a size fixed by FEATURES and LEXICON

    def run(cols: dict[str, list]) -> dict[str, list]:
        texts = [[w for w in WORD.findall(t) if w.isalpha() or any(map(str.isalpha, w))] if t else [] for t in cols["text"]]
        out = {k: v for k, v in cols.items() if k != "text"} | {"lang_pred": [], "score": [], "n_words": [], "n_switches": []}
        if words:
            out |= {"words": texts, "labels": []}
        if sent.value is None:
            n = len(texts)
            out |= {"lang_pred": ["und"] * n, "score": [0.0] * n, "n_words": [len(t) for t in texts], "n_switches": [0] * n}
            return out | ({"labels": [["und"] * len(t) for t in texts]} if words else {})
        holds("language", _TAGGERS.clear)
        tagger = _TAGGERS.get(0)
        if tagger is None or tagger.model is not sent.value:
            _TAGGERS[0] = tagger = Tagger(sent.value)
        labels = sent.value.labels
        for part in portions(texts):
            numbers = tagger.numbers(part)
            post = tagger.posteriors(numbers)
            best = post.argmax(axis=1)
            at = 0
            for x in numbers:
                n = len(x)
                if words:
                    out["labels"].append([labels[k] for k in best[at : at + n]])
                if n:
                    mass = post[at : at + n].sum(axis=0, dtype=np.float64)
                    k = int(mass.argmax())
                    out["lang_pred"].append(labels[k])
                    out["score"].append(float(min(1.0, mass[k] / n)))
                    out["n_switches"].append(int((best[at + 1 : at + n] != best[at : at + n - 1]).sum()))
                else:
                    out["lang_pred"].append("und")
                    out["score"].append(0.0)
                    out["n_switches"].append(0)
                out["n_words"].append(n)
                at += n
        return out

    return run


def label_words(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, words and labels (the language of each word) of every text: the stretches of code-switched text."""
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.ArrayType(T.StringType())) for c in ("words", "labels"))])
    label = labeller(docs.sparkSession, fit(sample(docs, per_language)), words=True)
    return map_rows(docs.select("doc_id", "text"), lambda cols: {k: v for k, v in label(cols).items() if k in ("doc_id", "words", "labels")}, schema)


def identify_languages(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Train on the rows of ``docs`` that aren't held out, and predict every row."""
    return identify(docs, fit(sample(docs, per_language)))


def keep_identified(docs: DataFrame, least_score: float, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The rows of ``docs``, with their columns, whose text has a letter and a language with at least ``least_score``."""
    model = fit(sample(docs, per_language))
    label = labeller(docs.sparkSession, model)

    def run(cols: dict[str, list]) -> dict[str, list]:
        found = label({"text": cols["text"]})
        keep = [i for i, (lang, score) in enumerate(zip(found["lang_pred"], found["score"], strict=True)) if lang != "und" and score >= least_score]
        return {name: [values[i] for i in keep] for name, values in cols.items()}

    return map_rows(docs, run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return identify_languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Language of text spans: script ranges, n-gram word scores and Viterbi.

A word's script leaves only languages that are written in it.  Its score for a
language is the log likelihood of its character n-grams and of the word itself
under hashed counts.  Viterbi with a penalty for each switch labels the words,
and runs of one label are the spans.  Scores come from arrays over the code
points of a whole batch; a text in which no stretch favours another language
enough to pay for a switch needs no search.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, stretches

#: First and last code point of script blocks; all other letters form one more class.
SCRIPTS = {
    "Latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "Devanagari": [(0x900, 0x97F)],
    "Bengali": [(0x980, 0x9FF)],
    "Thai": [(0xE00, 0xE7F)],
    "Georgian": [(0x10A0, 0x10FF)],
    "Hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "Kana": [(0x3040, 0x30FF)],
    "Han": [(0x3400, 0x9FFF), (0x20000, 0x2FA1F)],
}
BUCKET_BITS = 17
#: Characters that are scored at once.
PIECE = 1 << 20
_MULTIPLIERS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_TABLES: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    """By code point: 2 for letters, 1 for marks inside words, 0 for others; and the script's number."""
    if not _TABLES:
        kind = np.zeros(0x110000, dtype=np.uint8)
        for i in range(0x110000):
            c = unicodedata.category(chr(i))[0]
            kind[i] = 2 if c == "L" else 1 if c == "M" else 0
        script = np.full(0x110000, len(SCRIPTS), dtype=np.uint8)
        for n, ranges in enumerate(SCRIPTS.values()):
            for lo, hi in ranges:
                script[lo : hi + 1] = n
        _TABLES.update(kind=kind, script=script)
    return _TABLES


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) * _MULTIPLIERS[0] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


class Words:
    """Words of a batch of texts as arrays: where each begins and ends, its text, script and feature buckets."""

    def __init__(self, texts: list[str]):
        tables = _tables()
        points = np.frombuffer(("\n" + "\n".join(_lower(t) for t in texts) + "\n\n").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        kind = tables["kind"][points]
        inside = kind > 0
        edge = np.diff(inside.astype(np.int8))
        start, stop = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        letters = np.add.reduceat((kind == 2).astype(np.int64), start) if len(start) else np.empty(0, dtype=np.int64)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.text_start = 1 + np.cumsum(sizes + 1) - (sizes + 1)
        chars = np.where(inside, points, 0).astype(np.uint64)
        # reduceat counts up to the next word's start, which holds no letters after the word's end.
        some = letters > 0
        self.start, self.stop, self.letters = start[some], stop[some], letters[some]
        self.text = np.searchsorted(self.text_start, self.start, side="right") - 1
        self.script = tables["script"][points[self.start]] if len(self.start) else np.empty(0, dtype=np.uint8)
        a, b, c = chars[:-3], chars[1:-2], chars[2:-1]
        d = np.where(c > 0, chars[3:], 0)
        three = a * _MULTIPLIERS[1] + b * _MULTIPLIERS[2] + c * _MULTIPLIERS[3]
        self.grams = [_bucket(three), _bucket(three + (d + np.uint64(7)) * np.uint64(0xA0761D6478BD642F))]
        powers = np.power(np.uint64(0x100000001B3), (np.arange(len(chars), dtype=np.uint64) & np.uint64(63)))
        # A word's hash must not depend on where it stands, so it is a sum over (place in word, character).
        if len(self.start):
            place = np.arange(len(chars)) - np.repeat(np.concatenate([[0], start]), np.diff(np.concatenate([[0], start, [len(chars)]])))
            word = np.add.reduceat(chars * powers[place & 63] * _MULTIPLIERS[0], start)[some]
            self.whole = _bucket(word)
        else:
            self.whole = np.empty(0, dtype=np.int64)
        # Gram i is centred on code point i + 1.
        self.centre = inside[1:-2]

    def sums(self, table: np.ndarray, which: int) -> np.ndarray:
        """Sum over each word of the table's values for its n-grams."""
        values = np.where(self.centre, table[self.grams[which]], np.float32(0))
        ends = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        return ends[self.stop - 1] - ends[self.start - 1]


def pieces(texts: list[str], most: int) -> list[tuple[int, int, str]]:
    """(text, place in it, piece): texts of more than ``most`` characters are cut, if possible between words."""
    kind, out = _tables()["kind"], []
    for i, text in enumerate(texts):
        start = 0
        while len(text) - start > most:
            stop = start + most
            while stop > start and kind[ord(text[stop])] and kind[ord(text[stop - 1])]:
                stop -= 1
            stop = stop if stop > start else start + most
            out.append((i, start, text[start:stop]))
            start = stop
        out.append((i, start, text[start:]))
    return out


@dataclass
class ScoredWords:
    """Words of several texts, in order: whose they are, where, their letters and scores."""

    text: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    letters: np.ndarray
    score: np.ndarray


@dataclass
class LanguageModel:
    """Log likelihoods by feature bucket for each language, and the scripts each is written in."""

    names: list[str] = field(default_factory=list)
    grams: list[np.ndarray] = field(default_factory=list)
    words: np.ndarray | None = None
    scripts: np.ndarray | None = None
    switch: float = 20.0

    def scores(self, found: Words) -> np.ndarray:
        """(word, language) log likelihood; languages not written in the word's script are out, unless none is."""
        out = np.empty((len(found.start), len(self.names)))
        for k in range(len(self.names)):
            out[:, k] = found.sums(self.grams[0][k], 0) + found.sums(self.grams[1][k], 1) + self.words[k][found.whole]
        written = self.scripts[:, found.script].T
        out[~written & written.any(axis=1)[:, None]] -= 1e4
        return out

    def scored(self, texts: list[str], most: int = PIECE) -> ScoredWords:
        """Scores of the words of ``texts``, made over arrays of about ``most`` characters at once."""
        cut, parts = pieces(texts, most), []
        for part in stretches([len(p[2]) + 1 for p in cut], most):
            group = cut[part]
            found = Words([p[2] for p in group])
            if not len(found.start):
                continue
            owner, offset = np.array([p[0] for p in group]), np.array([p[1] for p in group])
            shift = offset[found.text] - found.text_start[found.text]
            parts.append((owner[found.text], found.start + shift, found.stop + shift, found.letters, self.scores(found)))
        if not parts:
            none = np.empty(0, dtype=np.int64)
            return ScoredWords(none, none, none, none, np.empty((0, len(self.names))))
        return ScoredWords(*[np.concatenate(c) for c in zip(*parts)])

    def label(self, score: np.ndarray) -> np.ndarray:
        """Language of each word of one text: the best path under the switching penalty."""
        best = int(score.sum(axis=0).argmax())
        sums = np.cumsum(score - score[:, best : best + 1], axis=0)
        low = np.minimum.accumulate(np.concatenate([np.zeros((1, sums.shape[1])), sums[:-1]]), axis=0)
        if (sums - low).max() <= self.switch / 2:
            # No stretch gains more than half a penalty, so no path with switches is better.
            return np.full(len(score), best)
        return viterbi(score, self.switch)


def viterbi(score: np.ndarray, switch: float) -> np.ndarray:
    """Best path; of equal ones it prefers to stay, then the first language."""
    rows = score.tolist()
    width, state = range(score.shape[1]), rows[0]
    back: list[tuple[int, list[bool]]] = []
    for row in rows[1:]:
        top = max(state)
        leader, floor = state.index(top), top - switch
        jump = [s < floor for s in state]
        state = [row[k] + (floor if jump[k] else state[k]) for k in width]
        back.append((leader, jump))
    at = state.index(max(state))
    path = [at]
    for leader, jump in reversed(back):
        if jump[at]:
            at = leader
        path.append(at)
    return np.array(path[::-1])


def fit(texts: list[str], langs: list[str], smoothing: float = 0.5, script_share: float = 0.02) -> LanguageModel:
    """Count n-grams and words of labelled texts; without texts the model knows no language."""
    names = sorted(set(langs))
    size = 1 << BUCKET_BITS
    grams = [np.full((len(names), size), smoothing) for _ in range(2)]
    words = np.full((len(names), size), smoothing)
    scripts = np.zeros((len(names), len(SCRIPTS) + 1))
    for part in stretches([len(t) + 1 for t in texts], PIECE):
        found = Words(texts[part])
        lang = np.array([names.index(x) for x in langs[part]], dtype=np.int64)
        owner = lang[found.text] if len(found.start) else np.empty(0, dtype=np.int64)
        of_gram = np.full(len(found.centre), -1)
        for k, (a, b) in zip(owner, zip(found.start, found.stop)):
            of_gram[a - 1 : b - 1] = k
        for k in range(len(names)):
            for table, buckets in zip(grams, found.grams):
                table[k] += np.bincount(buckets[(of_gram == k) & found.centre], minlength=size)
            words[k] += np.bincount(found.whole[owner == k], minlength=size)
            scripts[k] += np.bincount(found.script[owner == k], weights=found.letters[owner == k], minlength=len(SCRIPTS) + 1)
    logs = [np.log(t / t.sum(axis=1, keepdims=True)).astype(np.float32) for t in (*grams, words)]
    shares = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
    return LanguageModel(names, logs[:2], logs[2], shares >= script_share)


def labelled_sample(docs: DataFrame, allowed: Column, per_lang: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", longest: int = 50_000) -> tuple[list[str], list[str]]:
    """At most ``per_lang`` texts of each language, of up to ``longest`` characters, chosen by hash of the id; only these reach the driver."""
    ids = docs.where(allowed & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) <= longest))
    ids = ids.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"))
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    picked = ids.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_lang).select("_id", "_lang").distinct()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull() & (F.length("_text") <= longest))
    # Of the texts of an id and language one is collected.
    rows = sorted(tuple(r) for r in texts.join(F.broadcast(picked), ["_id", "_lang"]).groupBy("_id", "_lang").agg(F.max("_text")).collect())
    return [r[2] for r in rows], [r[1] for r in rows]


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = True) -> DataFrame:
    """(doc_id, lang_pred, score, n_spans[, spans]) of every row of ``docs``.

    lang_pred is the language with most letters, score its share of them, spans
    (start, stop, lang) in code points from the first to the last word of a run.
    Null texts, texts without a letter, and all texts if the model knows no
    language are "und" with score 0.  Of equal shares the first name counts.
    Rows with null or repeated ids are kept; long texts are read whole, in
    pieces; other columns are not read; an empty table gives an empty result.
    """
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("lang", T.StringType())])
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_spans", T.LongType())])
    if with_spans:
        schema.add("spans", T.ArrayType(span))

    def run(batch: dict[str, list]) -> dict[str, list]:
        n = len(batch["doc_id"])
        out = {"doc_id": batch["doc_id"], "lang_pred": ["und"] * n, "score": [0.0] * n, "n_spans": [0] * n, "spans": [[] for _ in range(n)]}
        if not model.names:
            return {k: out[k] for k in schema.names}
        found = model.scored([t or "" for t in batch["text"]])
        first = np.searchsorted(found.text, np.arange(n + 1))
        for i in range(n):
            a, b = int(first[i]), int(first[i + 1])
            if a == b:
                continue
            path = model.label(found.score[a:b])
            share = np.bincount(path, weights=found.letters[a:b], minlength=len(model.names))
            best = int(share.argmax())
            turn = np.flatnonzero(np.diff(path)) + 1
            out["lang_pred"][i], out["score"][i], out["n_spans"][i] = model.names[best], float(share[best] / share.sum()), len(turn) + 1
            if with_spans:
                for lo, hi in zip([0, *turn.tolist()], [*turn.tolist(), b - a]):
                    out["spans"][i].append({"start": int(found.start[a + lo]), "stop": int(found.stop[a + hi - 1]), "lang": model.names[int(path[lo])]})
        return {k: out[k] for k in schema.names}

    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, schema)

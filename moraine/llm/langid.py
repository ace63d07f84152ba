"""Language identification by a linear-chain conditional random field over words.

A word is a run of letters (Unicode categories L, and marks inside it), lower-cased, cut at changes of script and, beyond ``PIECE`` letters, into even pieces, so that scripts
without spaces are read whole.  It has features: itself if the learned lexicon holds it, prefixes and suffixes of 1 to 3 letters, and
letter 2- and 3-grams with its boundaries, hashed to 2^16 buckets.  Labels are languages; transitions between neighbouring
words' labels are learned.  The training sequences are code-switched: runs of words from labelled texts of different languages,
one after another, so that a switch inside a text can be told.  Forward-backward gives each word's label
probabilities; a text's language is the one with the largest sum of them, its score that sum over the number of words.

Forward-backward runs over a whole batch of texts at once: words are cut into blocks, each block's transfer matrix is made for all
blocks together, a short walk carries the messages from block to block, and all blocks are then filled in together.  At the first
word of a text the transfer forgets what was before.  Exact for texts of any length.

Training takes at most ``PER_LANG`` texts of a language and ``CHARS`` characters in all, those of smallest text hash: the documented bound.

Defined results: a null text, or one without letters, is ``und`` with score 0; rows without text or lang are not learned
from; without any labelled text all is ``und``; ties go to the language that sorts first; repeated rows stay; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm._common import small_batches
from moraine.llm.sampling import choose, text_hash, texts_of

WORD = re.compile(r"[^\W\d_]+")  # letters, and signs such as ² that letters() takes out
BEYOND_LATIN = re.compile("[^\x00-\u024f]")
PER_LANG, CHARS = 400, 2_400_000
LEXICON = 3000  # most frequent words of each language in the training sample
BUCKETS = 1 << 16
PIECE = 24  # letters of a word at most
SLOTS = 2 * PIECE + 6  # features of such a word
BLOCK = 64  # words in a block of forward-backward
CACHE = 200_000  # words whose emissions a worker keeps
WORDS_AT_ONCE = 400_000


@dataclass
class Crf:
    labels: list[str]
    lexicon: frozenset
    weights: np.ndarray  # BUCKETS + 1 by labels; the last row is zero, for empty slots
    transitions: np.ndarray  # labels by labels
    start: np.ndarray


# caches of a process; functools' own can't travel to workers by value
_MARKED: list[re.Pattern] = []
_SCRIPTS: dict[str, str] = {}


def marked_word() -> re.Pattern:
    """Letters, and the marks that follow them."""
    if not _MARKED:
        marks = "".join(chr(c) for c in range(0x300, sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "M")
        _MARKED.append(re.compile(rf"[^\W\d_](?:[^\W\d_]|[{marks}])*"))
    return _MARKED[0]


def letters(run: str) -> list[str]:
    """The parts of a run that are letters and marks, without those that are marks only."""
    if run.isalpha():
        return [run]
    parts = "".join(c if c.isalpha() or unicodedata.category(c)[0] == "M" else " " for c in run).split()
    return [p for p in parts if any(c.isalpha() for c in p)]


def script(letter: str) -> str:
    """The script of a letter by its Unicode name; empty for marks and signs of no script."""
    if letter not in _SCRIPTS:
        name = re.split("[ -]", unicodedata.name(letter, "").removeprefix("FULLWIDTH ").removeprefix("HALFWIDTH "))[0]
        _SCRIPTS[letter] = "" if unicodedata.category(letter)[0] == "M" or name in ("MODIFIER", "MICRO", "FEMININE", "MASCULINE") else name
    return _SCRIPTS[letter]


def pieces(run: str) -> list[str]:
    """A run of letters, cut at changes of script and into pieces of PIECE letters at most."""
    cuts, held = [0], ""
    for i, letter in enumerate(run):
        now = script(letter) or held
        if held and now != held:
            cuts.append(i)
        held = now
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(run)]):
        n = max(1, -(-(b - a) // PIECE))
        out += [run[a + (b - a) * i // n : a + (b - a) * (i + 1) // n] for i in range(n)]
    return out


def words_of(text: str) -> list[str]:
    text = text.lower()
    plain = not BEYOND_LATIN.search(text)
    runs = (WORD if plain else marked_word()).findall(text)
    if not text.isascii() and not all(map(str.isalpha, runs)):
        runs = [part for run in runs for part in letters(run)]
    if not runs or plain and max(map(len, runs)) <= PIECE:
        return runs
    return [p for run in runs for p in ([run] if len(run) <= PIECE and run.isascii() else pieces(run))]


def word_features(word: str, lexicon) -> list[int]:
    """Buckets of a lower-cased word of PIECE letters at most: SLOTS or fewer."""
    s = f"^{word}$"
    names = [f"p{word[:k]}" for k in (1, 2, 3) if k <= len(word)] + [f"s{word[-k:]}" for k in (1, 2, 3) if k <= len(word)]
    names += [f"g{s[i : i + 3]}" for i in range(len(s) - 2)] + [f"b{s[i : i + 2]}" for i in range(1, len(s) - 2)]
    if word in lexicon:
        names.insert(0, f"w{word}")
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in names]


def feature_matrix(words: list[str], lexicon) -> np.ndarray:
    out = np.full((len(words), SLOTS), BUCKETS, np.int32)
    for i, w in enumerate(words):
        f = word_features(w, lexicon)
        out[i, : len(f)] = f
    return out


def marginals(e: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Label probabilities of each word: e (words by labels) are emission scores, ``first`` marks the first word of a text."""
    n, k = e.shape
    blocks = -(-n // BLOCK)
    pad = blocks * BLOCK - n
    x = np.exp(e - e.max(axis=1, keepdims=True))
    x = np.concatenate([x, np.ones((pad, k))]).reshape(blocks, BLOCK, k)
    new = np.concatenate([first, np.ones(pad, bool)]).reshape(blocks, BLOCK)
    move, begin = np.exp(trans), np.exp(start)
    # the transfer matrix of each block: rows are the label before it
    m = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for t in range(BLOCK):
        stepped = (m.reshape(-1, k) @ move).reshape(blocks, k, k)
        fresh = new[:, t]
        if fresh.any():
            # the label after it is free, but what was before it still weighs by the label before the block
            stepped[fresh] = m[fresh].sum(axis=2, keepdims=True) * begin
        m = stepped * x[:, t, None, :]
        m /= m.max(axis=(1, 2), keepdims=True)
    into, after = np.empty((blocks, k)), np.empty((blocks, k))
    v = np.ones(k)
    for s in range(blocks):
        into[s] = v
        v = v @ m[s]
        v = v / v.sum()
    v = np.ones(k)
    for s in range(blocks - 1, -1, -1):
        after[s] = v
        v = m[s] @ v
        v = v / v.sum()
    alpha = np.empty_like(x)
    a = into
    for t in range(BLOCK):
        a = np.where(new[:, t, None], begin, a @ move) * x[:, t]
        a = a / a.sum(axis=1, keepdims=True)
        alpha[:, t] = a
    # what stands after a word: the message of the next one, or nothing if that begins another text
    b = after
    gamma = alpha
    for t in range(BLOCK - 1, -1, -1):
        g = gamma[:, t] * b
        gamma[:, t] = g / g.sum(axis=1, keepdims=True)
        back = (x[:, t] * b) @ move.T
        b = np.where(new[:, t, None], 1.0, back)
        b = b / b.sum(axis=1, keepdims=True)
    return gamma.reshape(-1, k)[:n]


def _pairwise(e, mask, trans, start, y):
    """Log-likelihood gradients of a batch of equally long padded sequences: expected minus seen."""
    b, n, k = e.shape
    x = np.exp(e - e.max(axis=2, keepdims=True))
    move, begin = np.exp(trans), np.exp(start)
    alpha, beta = np.empty_like(x), np.ones_like(x)
    alpha[:, 0] = begin * x[:, 0]
    alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, n):
        a = (alpha[:, t - 1] @ move) * x[:, t]
        alpha[:, t] = np.where(mask[:, t, None], a / a.sum(axis=1, keepdims=True), alpha[:, t - 1])
    g_trans = np.zeros_like(trans)
    for t in range(n - 2, -1, -1):
        inner = x[:, t + 1] * beta[:, t + 1]
        back = inner @ move.T
        on = mask[:, t + 1, None]
        beta[:, t] = np.where(on, back / back.sum(axis=1, keepdims=True), beta[:, t + 1])
        pair = alpha[:, t, :, None] * move * inner[:, None, :]
        pair = pair / pair.sum(axis=(1, 2), keepdims=True) * on[:, :, None]
        g_trans += pair.sum(axis=0)
        np.subtract.at(g_trans, (y[:, t][mask[:, t + 1]], y[:, t + 1][mask[:, t + 1]]), 1.0)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=2, keepdims=True)
    g_start = gamma[:, 0].sum(axis=0) - np.bincount(y[:, 0], minlength=k)
    g_emit = gamma
    np.put_along_axis(g_emit, y[:, :, None], np.take_along_axis(g_emit, y[:, :, None], 2) - 1.0, 2)
    return g_emit * mask[:, :, None], g_trans, g_start


def fit(samples: list[tuple[str, str]], rounds: int = 40, length: int = 48, seed: int = 11) -> Crf:
    """A model from (lang, text) pairs, in any order: they are sorted first."""
    labels = sorted({lang for lang, _ in samples})
    k, rng = len(labels), np.random.default_rng(seed)
    by = {lang: [] for lang in labels}
    for lang, text in sorted(samples):
        by[lang] += words_of(text)
    lexicon = frozenset(w for lang in labels for w, _ in Counter(by[lang]).most_common(LEXICON))
    index: dict[str, int] = {}
    ids = [np.array([index.setdefault(w, len(index)) for w in by[lang]], np.int64) for lang in labels]
    # code-switched sequences: runs of 6 to 40 words, each from a language drawn anew
    at, total, seq, y = [0] * k, sum(map(len, ids)), [], []
    open_ = [i for i in range(k) if len(ids[i])]
    while open_ and len(seq) < total:
        i = int(rng.choice(open_))
        run = int(rng.integers(6, 41))
        piece = ids[i][at[i] : at[i] + run]
        at[i] += len(piece)
        if at[i] >= len(ids[i]):
            open_.remove(i)
        seq += piece.tolist()
        y += [i] * len(piece)
    if not seq:
        return Crf([], frozenset(), np.zeros((BUCKETS + 1, 0)), np.zeros((0, 0)), np.zeros(0))
    n = -(-len(seq) // length)
    pad = n * length - len(seq)
    mask = np.concatenate([np.ones(len(seq), bool), np.zeros(pad, bool)]).reshape(n, length)
    seq, y = np.array(seq + [0] * pad).reshape(n, length), np.array(y + [0] * pad).reshape(n, length)
    feats = feature_matrix(list(index), lexicon)
    w, trans, start = np.zeros((BUCKETS + 1, k)), np.zeros((k, k)), np.zeros(k)
    sums = [np.full_like(p, 1e-6) for p in (w, trans, start)]
    # classes weigh the same, however many words the sample has of each
    count = np.bincount(y[mask], minlength=k).astype(float)
    weight = np.where(count > 0, count.sum() / (k * np.maximum(count, 1)), 0.0)
    for _ in range(rounds):
        emit = np.concatenate([w[feats[i : i + 4096]].sum(axis=1) for i in range(0, len(feats), 4096)])
        g_emit, g_trans, g_start = _pairwise(emit[seq], mask, trans, start, y)
        g_emit *= weight[y][:, :, None]
        word = np.stack([np.bincount(seq.ravel(), weights=g_emit[:, :, j].ravel(), minlength=len(index)) for j in range(k)], axis=1)
        g_w = np.stack([np.bincount(feats.ravel(), weights=np.repeat(word[:, j], SLOTS), minlength=BUCKETS + 1) for j in range(k)], axis=1)
        g_w[BUCKETS] = 0
        for p, g, s, l2 in zip((w, trans, start), (g_w, g_trans, g_start), sums, (0.01, 0.01, 1.0)):
            g = g + l2 * p
            s += g * g
            p -= 0.5 * g / np.sqrt(s)
        w[BUCKETS] = 0
    return Crf(labels, lexicon, w.astype(np.float32), trans, start)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, chars: int = CHARS) -> Crf:
    rows = docs.select(text_hash(F.col(text_col)).alias("h"), F.col(lang_col).alias("label"), F.length(F.col(text_col)).alias("size"), F.col(text_col).isNotNull().alias("there")).where("there")
    chosen = choose(rows.select("h", "label", "size"), per_lang, chars)
    if not chosen:
        return fit([])
    got = texts_of(docs, text_col, chosen, "string").dropDuplicates(["h", "label"]).collect()
    return fit([(r["label"], r["text"]) for r in got])


class Tagger:
    """Scores texts with a model; keeps the emissions of words it has met, up to CACHE of them."""

    def __init__(self, crf: Crf):
        self.crf, self.row = crf, {}
        self.emissions = np.empty((0, len(crf.labels)))

    def rows_of(self, words: list[str]) -> np.ndarray:
        if len(self.row) + len(words) > CACHE + WORDS_AT_ONCE:
            self.row, self.emissions = {}, self.emissions[:0]
        new = [w for w in words if w not in self.row]
        if new:
            for w in new:
                self.row[w] = len(self.row)
            parts = [self.crf.weights[feature_matrix(new[i : i + 8192], self.crf.lexicon)].sum(axis=1, dtype=np.float64) for i in range(0, len(new), 8192)]
            self.emissions = np.concatenate([self.emissions, *parts])
        return np.array([self.row[w] for w in words], np.int64)

    def tag(self, texts: list[str | None]) -> list[tuple[str, float, int, np.ndarray]]:
        """(lang, score, number of words, label index of each word) of each text."""
        if not self.crf.labels:
            return [("und", 0.0, 0, np.empty(0, np.int64)) for _ in texts]
        words, ends = [], []
        for t in texts:
            words += words_of(t) if t else ()
            ends.append(len(words))
        if not words:
            return [("und", 0.0, 0, np.empty(0, np.int64)) for _ in texts]
        coded = pa.array(words, pa.string()).dictionary_encode()
        e = self.emissions_of(coded)
        begins = [0, *ends[:-1]]
        first = np.zeros(len(words), bool)
        first[[b for b, n in zip(begins, ends) if n > b]] = True
        gamma = marginals(e, first, self.crf.transitions, self.crf.start)
        best, out = gamma.argmax(axis=1), []
        sums = np.concatenate([np.zeros((1, gamma.shape[1])), np.cumsum(gamma, axis=0)])
        for b, n in zip(begins, ends):
            if n == b:
                out.append(("und", 0.0, 0, best[:0]))
                continue
            total = (gamma[b:n].sum(axis=0) if n - b < 1000 else sums[n] - sums[b]) / (n - b)
            i = int(np.argmax(np.round(total, 9)))
            out.append((self.crf.labels[i], float(min(1.0, max(0.0, total[i]))), n - b, best[b:n]))
        return out

    def emissions_of(self, coded) -> np.ndarray:
        rows = self.rows_of(coded.dictionary.to_pylist())
        return self.emissions[rows][coded.indices.to_numpy()]


def identify(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """One row per input row: id, lang, score, n_words, and with ``spans`` the runs of words of one language: array of (first word,
    number of words, lang)."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # plain values: a broadcast is pickled by reference, and executors need not have this package
    model = docs.sparkSession.sparkContext.broadcast((crf.labels, sorted(crf.lexicon), crf.weights, crf.transitions, crf.start))
    kind = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))

    def runs(labels: np.ndarray, names: list[str]) -> list[dict]:
        if not len(labels):
            return []
        cut = np.concatenate([[0], np.flatnonzero(np.diff(labels)) + 1, [len(labels)]])
        return [{"first": int(a), "words": int(b - a), "lang": names[labels[a]]} for a, b in zip(cut[:-1], cut[1:])]

    def kernel(batches):
        labels, lexicon, *rest = model.value
        tagger = Tagger(Crf(labels, frozenset(lexicon), *rest))
        for batch in batches:
            got, part, size = [], [], 0
            for t in batch.column(1):
                part.append(t.as_py())
                size += len(part[-1] or "")
                if size > WORDS_AT_ONCE * 5:
                    got += tagger.tag(part)
                    part, size = [], 0
            got += tagger.tag(part)
            arrays = [batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.int64())]
            if spans:
                arrays.append(pa.array([runs(g[3], labels) for g in got], kind))
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "lang", "score", "n_words"] + ["spans"] * spans)

    schema = f"id {source.schema['id'].dataType.simpleString()}, lang string, score double, n_words bigint" + ", spans array<struct<first:bigint,words:bigint,lang:string>>" * spans
    return source.transform(small_batches).mapInArrow(kernel, schema)

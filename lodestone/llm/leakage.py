"""Evaluation texts leaking into training text, by latent semantic retrieval and exact checks.

Held-out items are cut into overlapping passages, TF-IDF vectors of character shingles weighted by their
frequency in all documents and in all passages. A randomised SVD, computed over distributed rows so that only small square
matrices reach the driver, gives a latent space of far fewer dimensions than there are passages. Their
places in it are indexed by the nearest of a few centres. Documents are read in windows; a window that has
enough of the passages' shingles is projected into the space, looks up the passages of its nearest centres
and takes those of a sufficient cosine as candidates. Document and candidate item are then compared
themselves: the stretch of consecutive words (characters for Chinese) they share, the longest common
subsequence of the window and the item for paraphrases, and whether the item's last sentence, the question
or answer, stands in the document too.

The documents are read once; what could hold a passage is written to the shared folder, the rest only
counts towards the frequencies. The corpus is never collected, joined or indexed. Held-out sets are taken in
blocks of bounded size, so what is broadcast does not grow with either side.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from ..session import cut, spread

_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*)?/?>|<!--.*?-->", re.S)
_LINK = re.compile(r"!?\[([^\]\[]*)\]\([^()\s]*(?:\s+\"[^\"]*\")?\)")
_LINE_MARK = re.compile(r"^[ \t]*(?:[>#*+•|;%/!:=~\-–—·]+[ \t]*)*(?:\(?\d{1,4}[.):|\]][ \t]+)?", re.M)
_ESCAPE = re.compile(r"\\u\{?([0-9a-fA-F]{4,6})\}?|\\U([0-9a-fA-F]{8})|\\x([0-9a-fA-F]{2})|\\([nrt])(?![a-z])")
#: Format characters, private and unassigned ones, fillers and variation selectors cannot be seen.
_INVISIBLE = regex.compile(r"[\p{Cf}\p{Co}\p{Cn}\u034f\u115f\u1160\u3164\ufe00-\ufe0f]+")
_HAN = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")


def _unescape(m):
    code = m[1] or m[2] or m[3]
    if not code:
        return " "
    try:
        return chr(int(code, 16))
    except ValueError:
        return m[0]


def plain(text: str) -> str:
    """The text without case, markup, escapes, invisible characters and compatibility forms."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "\\" in text:
        text = _ESCAPE.sub(_unescape, text)
    if "%" in text and re.search(r"%[0-9A-Fa-f]{2}", text):
        text = re.sub(r"(?:%[0-9A-Fa-f]{2})+", lambda m: unquote(m[0], errors="replace"), text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = _INVISIBLE.sub("", text)
    if "<" in text:
        text = _TAG.sub("", text)
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    text = _LINE_MARK.sub("", text)
    text = text.casefold()
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


_WORD = re.compile(r"[^\W_]+")


def stream(text: str) -> tuple[str, np.ndarray]:
    """The letters and digits of a text without anything between them, and whether a word starts at each
    position (one more position than letters: the end)."""
    words = _WORD.findall(plain(text))
    out = "".join(words)
    starts = np.zeros(len(out) + 1, bool)
    if words:
        ends = np.cumsum([len(w) for w in words])
        starts[ends] = True
        starts[0] = True
    return out, starts


_M = [np.uint64(pow(0x9E3779B97F4A7C15, i, 1 << 64)) for i in range(1, 7)]


def grams(chars: str) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the shingles of a stream: three characters that end in an ideograph or kana,
    six otherwise; and 3 or 1 as the width of each character."""
    a = np.frombuffer(chars.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    n = len(a)
    wide = ((a >= 0x3040) & (a <= 0x30FF)) | ((a >= 0x3400) & (a <= 0x9FFF)) | ((a >= 0xF900) & (a <= 0xFAFF))
    if n < 6:
        return np.zeros(n, np.uint64), wide
    h3 = np.zeros(n, np.uint64)
    h3[2:] = a[2:] * _M[0] + a[1:-1] * _M[1] + a[:-2] * _M[2]
    h6 = np.zeros(n, np.uint64)
    h6[5:] = h3[5:] + a[2:-3] * _M[3] + a[1:-4] * _M[4] + a[:-5] * _M[5]
    h = np.where(wide, h3 | np.uint64(1), h6 & ~np.uint64(1))
    return h ^ (h >> np.uint64(31)), wide


class Item:
    """A held-out item, ready for the checks."""

    def __init__(self, key, lang, text, min_words, min_chars):
        self.key = key
        self.chars, starts = stream(text or "")
        self.at = np.flatnonzero(starts)
        han = len(_HAN.findall(self.chars))
        self.han = (lang or "").lower().startswith("zh") or han * 2 > len(self.chars)
        if self.han:
            self.needles = [self.chars[i : i + min_chars] for i in range(len(self.chars) - min_chars + 1)]
            ends, step = range(len(self.chars) + 1), (min_chars + 1) // 2
        else:
            self.needles = [self.chars[self.at[i] : self.at[i + min_words]] for i in range(len(self.at) - min_words)]
            ends, step = self.at, (min_words + 1) // 2
        # every stretch holds one of these pieces, which follow one another
        self.seeds = [self.chars[ends[i] : ends[i + step]] for i in range(0, len(ends) - step, step)]
        sentences = [x for x in re.split(r"(?<=[.!?])\s+|(?<=[。！？])|[:：]\s*", text or "") if x.strip()]
        self.last = stream(sentences[-1])[0] if sentences else ""
        self.least = min(map(self.weight, self.needles), default=0)

    @staticmethod
    def weight(chars: str) -> int:
        return len(chars) + 2 * len(_HAN.findall(chars))

    def found(self, chars: str, starts: np.ndarray) -> bool:
        """Whether a stretch of the item stands in the text; words at its ends must be whole words there."""
        if not any(seed in chars for seed in self.seeds):
            return False
        for needle in self.needles:
            at = chars.find(needle)
            while at >= 0:
                if self.han or (starts[at] and starts[at + len(needle)]):
                    return True
                at = chars.find(needle, at + 1)
        return False

    def parts(self) -> list[str]:
        return list(self.chars) if self.han else [self.chars[i:j] for i, j in zip(self.at, self.at[1:])]


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, all of ``a`` at once in the bits of one number."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = state = (1 << len(a)) - 1
    for y in b:
        hit = state & where.get(y, 0)
        state = (state + hit | state - hit) & full
    return len(a) - state.bit_count()


def _gaussian(features: np.ndarray, width: int) -> np.ndarray:
    """Reproducible normal numbers for each feature, wherever it is met."""
    x = (features[:, None] * np.uint64(0xD1342543DE82EF95) + np.arange(width, dtype=np.uint64)[None, :] * np.uint64(0x2545F4914F6CDD1D)).astype(np.uint64)
    for _ in range(2):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
    u = (x >> np.uint64(40)).astype(np.float64) / (1 << 24)
    v = (x & np.uint64(0xFFFFFF)).astype(np.float64) / (1 << 24)
    return np.sqrt(-2 * np.log(u + 1e-9)) * np.cos(2 * np.pi * v)


def randomised_svd(rows: DataFrame, rank: int = 64, oversample: int = 16) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """The first ``rank`` singular triplets of a sparse matrix given as rows ``id, features array<bigint>,
    weights array<double>``: left factors ``id, factor``, singular values, right factors ``feature, factor``.
    Rows stay distributed; products with the transposed matrix are sums by feature; only matrices of ``rank +
    oversample`` rows and columns reach the driver."""
    width = rank + oversample
    wide = pa.list_(pa.float32())

    def sketch(batches):
        for b in batches:
            f, w = b.column(1).to_pylist(), b.column(2).to_pylist()
            y = [(np.asarray(v)[:, None] * _gaussian(np.asarray(k, np.int64).view(np.uint64), width)).sum(0).tolist() if k else [0.0] * width for k, v in zip(f, w)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(y, wide)], ["id", "features", "weights", "y"])

    kind = dict(rows.dtypes)["id"]
    shape = f"id {kind}, features array<bigint>, weights array<double>, y array<float>"

    def square(df):
        def run(batches):
            total = np.zeros((width, width))
            for b in batches:
                y = np.asarray(b.column(0).to_pylist(), np.float64).reshape(-1, width)
                total += y.T @ y
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["g"])

        return sum((np.frombuffer(r["g"]).reshape(width, width) for r in df.select("y").mapInArrow(run, "g binary").collect()), np.zeros((width, width)))

    def times(df, matrix, columns, schema):
        """``y`` times a small matrix, beside other columns."""

        def run(batches):
            for b in batches:
                y = np.asarray(b.column(len(columns)).to_pylist(), np.float64).reshape(-1, width) @ matrix
                yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(y.tolist(), wide)], [*columns, schema.split()[-2]])

        return df.select(*columns, "y").mapInArrow(run, schema)

    def by_feature(df):
        """The transposed product: one row per feature, summed in each task and then over the tasks."""

        def run(batches):
            fs, ys = [], []
            for b in batches:
                for f, w, y in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                    fs.append(np.asarray(f, np.int64))
                    ys.append(np.asarray(w)[:, None] * np.asarray(y)[None, :])
            if fs:
                keys, at = np.unique(np.concatenate(fs), return_inverse=True)
                total = np.zeros((len(keys), width))
                np.add.at(total, at, np.concatenate(ys))
                for i in range(0, len(keys), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 4096]), pa.array(total[i : i + 4096].tolist(), wide)], ["feature", "y"])

        part = df.mapInArrow(run, "feature bigint, y array<float>")
        summed = part.groupBy("feature").agg(F.collect_list("y").alias("ys"))  # one per task and feature
        add = F.aggregate("ys", F.array_repeat(F.lit(0.0).cast("float"), width), lambda acc, y: F.zip_with(acc, y, lambda p, q: (p + q).cast("float")))
        return summed.select("feature", add.alias("y"))

    def root(gram):
        val, vec = np.linalg.eigh(gram)
        good = val > max(val.max(), 1e-300) * 1e-9
        inv = np.zeros_like(val)
        inv[good] = 1 / np.sqrt(val[good])
        return vec * inv

    y = cut(rows.select("id", "features", "weights").mapInArrow(sketch, shape))
    q = cut(times(y, root(square(y)), ("id", "features", "weights"), shape))
    b = cut(by_feature(q))
    val, vec = np.linalg.eigh(square(b))
    order = np.argsort(val)[::-1][:rank]
    order = order[val[order] > max(val.max(), 1e-300) * 1e-9]
    sigma = np.sqrt(val[order])
    u = times(q, vec[:, order], ("id",), f"id {kind}, factor array<float>")
    v = times(b, vec[:, order] / sigma, ("feature",), "feature bigint, factor array<float>")
    return u, sigma, v


def _cells(chars: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hash and half window of each position, and the weight of each: 3 for an ideograph, else 1."""
    h, wide = grams(chars)
    weight = np.where(wide, 3, 1)
    return h, np.cumsum(weight) // max(1, width // 2), weight


class Space:
    """What a task needs to search one block of held-out items: their shingles, the right factors, and the
    places of their passages in lists by the nearest of a few centres."""

    def __init__(self, items, vocab, idf, right, sigma, places, owner, probes, seed=20240607):
        self.items, self.vocab, self.probes = items, vocab, probes
        self.bits = bitmap(vocab)
        self.project = (right * idf[:, None]).astype(np.float32)
        norm = np.sqrt((places**2).sum(1, keepdims=True))
        places = (places / np.maximum(norm, 1e-12)).astype(np.float32)
        rng = np.random.default_rng(seed)
        centres = places[rng.permutation(len(places))[: max(1, 2 * math.isqrt(len(places)))]]
        for _ in range(6):
            near = (places @ centres.T).argmax(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, places)
            size = np.sqrt((sums**2).sum(1, keepdims=True))
            centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
        near = (places @ centres.T).argmax(1)
        order = np.argsort(near, kind="stable")
        self.centres, self.places, self.owner = centres, places[order], owner[order]
        self.first = np.searchsorted(near[order], np.arange(len(centres) + 1))

    def candidates(self, z: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of ``z``, number of the item, cosine) of the passages that the rows find."""
        z = z / np.maximum(np.sqrt((z**2).sum(1, keepdims=True)), 1e-12)
        near = z @ self.centres.T
        n = min(self.probes, near.shape[1])
        probe = np.argpartition(-near, n - 1, axis=1)[:, :n]
        rows, lists = np.repeat(np.arange(len(z)), n), probe.ravel()
        order = np.argsort(lists, kind="stable")
        rows, lists = rows[order], lists[order]
        out = []
        for c in np.unique(lists):
            a, b = np.searchsorted(lists, [c, c + 1])
            i, j = self.first[c], self.first[c + 1]
            cos = z[rows[a:b]] @ self.places[i:j].T
            r, p = np.nonzero(cos >= cosine)
            out.append((rows[a:b][r], self.owner[i:j][p], cos[r, p]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        return tuple(np.concatenate(x) for x in zip(*out))


_BITS = 22


def bitmap(vocab: np.ndarray) -> np.ndarray:
    """A bit for each value that the last bits of a shingle of the vocabulary have."""
    out = np.zeros(1 << _BITS, bool)
    out[(vocab >> np.uint64(1)) & np.uint64((1 << _BITS) - 1)] = True
    return out


def lookup(vocab: np.ndarray, bits: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``h`` that hold a shingle of the vocabulary, and its number there."""
    pos = np.flatnonzero(bits[(h >> np.uint64(1)) & np.uint64((1 << _BITS) - 1)])
    f = np.searchsorted(vocab, h[pos])
    f[f == len(vocab)] = 0
    hit = (vocab[f] == h[pos]) & (h[pos] != 0)
    return pos[hit], f[hit]


def _windows(half: np.ndarray, weight: np.ndarray, least: int) -> np.ndarray:
    """The windows (of two halves, one half apart) with hits of at least ``least`` weight, for hits in order."""
    per = np.bincount(half, weight)
    both = per + np.append(per[1:], 0)
    return np.flatnonzero(both >= least)


def passages(items: list[Item], window: int):
    """Number of the item and shingles with their counts of each passage: windows one half apart."""
    for i, it in enumerate(items):
        h, half, _ = _cells(it.chars, window)
        for w in range(int(half[-1]) + 1 if len(half) else 0):
            f, n = np.unique(h[(half >= w) & (half <= w + 1) & (h != 0)], return_counts=True)
            if len(f) and (w == 0 or half[-1] > w):  # the last half alone is part of the window before
                yield i, f, n


def leaks(
    documents: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    item_lang: str = "lang",
    min_words: int = 12,
    min_chars: int = 24,
    rank: int = 128,
    window: int = 160,
    cosine: float = 0.55,
    probes: int = 16,
    share: float = 0.8,
    block: int = 200_000,
) -> DataFrame:
    """``key, item_key, kind, cosine, common, answered``: each document that holds at least ``min_words``
    consecutive words of an item (``min_chars`` characters of a Chinese one; kind ``stretch``), or a window of
    which the share ``share`` and as many words stand in the item in the same order (kind ``paraphrase``);
    with the best cosine of its windows, the longest common subsequence of the best one and the item, and
    whether the item's last sentence stands in the document.

    Case, punctuation, spacing, line marks, markup, escapes, invisible characters and compatibility forms
    are ignored. Null and blank texts hold nothing; items shorter than a stretch cannot leak; repeated
    rows give one row. Items are taken in blocks of ``block`` characters (an item counts with at least 500),
    each searched by itself against all documents; the shingles of a block bound what is broadcast."""
    usable = items.where(F.col(item_text).isNotNull() & F.col(item_key).isNotNull())
    key_kind, item_kind = dict(documents.dtypes)[key], dict(items.dtypes)[item_key]
    size = usable.agg(F.sum(F.greatest(F.length(item_text), F.lit(500)))).first()[0] or 0
    blocks = max(1, -(-size // block))
    how = (min_words, min_chars, rank, window, cosine, probes, share)
    out = None
    for n in range(blocks):
        mine = usable.where(F.pmod(F.xxhash64(item_key), F.lit(blocks)) == n) if blocks > 1 else usable
        held = [Item(*r, min_words, min_chars) for r in mine.select(item_key, item_lang, item_text).dropDuplicates([item_key]).orderBy(item_key).toLocalIterator()]
        held = [it for it in held if it.needles]
        got = _search(documents, held, key, text, key_kind, item_kind, *how) if held else None
        out = got if out is None else out if got is None else out.unionByName(got)
    if out is None:
        return documents.sparkSession.createDataFrame([], f"{key} {key_kind}, {item_key} {item_kind}, kind string, cosine double, common bigint, answered boolean")
    best = F.max(F.struct(F.col("kind") == "stretch", "cosine", "common", "answered", "kind")).alias("x")
    return out.groupBy("key", "item").agg(best).select(F.col("key").alias(key), F.col("item").cast(item_kind).alias(item_key), "x.kind", "x.cosine", "x.common", "x.answered")


def _search(documents, held, key, text, key_kind, item_kind, min_words, min_chars, rank, window, cosine, probes, share) -> DataFrame:
    spark = documents.sparkSession
    kind_of = {k: to_arrow_type(_parse_datatype_string(k)) for k in (key_kind, item_kind)}
    cells = list(passages(held, window))  # bounded by the block, as is all below
    vocab = np.unique(np.concatenate([f for _, f, _ in cells]))
    at = [np.searchsorted(vocab, f) for _, f, _ in cells]
    owner = np.array([i for i, _, _ in cells])
    # a shared stretch is hits but for its first five letters; half a window holds a stretch or is full of it
    least = max(1, min(min(it.least for it in held), window // 2) - 15)
    words = spark.sparkContext.broadcast((vocab, bitmap(vocab)))
    data = spread(documents.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")))

    def read(batches):
        """One row per shingle of the items with its number of documents (feature -1: all), and one per
        document with a window that has enough of them."""
        known, bits = words.value
        seen, docs = np.zeros(len(known), np.int64), 0
        names, none = ["key", "chars", "starts", "feature", "n"], [None]
        for b in batches:
            keys, chars_, starts_ = [], [], []
            for k, t in zip(b.column(0), b.column(1).to_pylist()):
                docs += 1
                chars, starts = stream(t)
                h, half, weight = _cells(chars, window)
                pos, f = lookup(known, bits, h)
                if len(pos):
                    seen[np.unique(f)] += 1
                    if len(_windows(half[pos], weight[pos], least)):
                        keys.append(k.as_py())
                        chars_.append(chars)
                        starts_.append(np.packbits(starts).tobytes())
            m = len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(chars_, pa.string()), pa.array(starts_, pa.binary()), pa.array(none * m, pa.int64()), pa.array(none * m, pa.int64())], names)
        hit = np.flatnonzero(seen)
        m = len(hit) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(m, kind_of[key_kind]), pa.nulls(m, pa.string()), pa.nulls(m, pa.binary()), pa.array([-1, *hit.tolist()], pa.int64()), pa.array([docs, *seen[hit].tolist()], pa.int64())], names
        )

    once = cut(data.mapInArrow(read, f"key {key_kind}, chars string, starts binary, feature bigint, n bigint"))
    df, total = np.zeros(len(vocab)), 0
    for r in once.where("feature IS NOT NULL").groupBy("feature").agg(F.sum("n").alias("n")).collect():  # at most the items' shingles
        if r["feature"] < 0:
            total = r["n"]
        else:
            df[r["feature"]] = r["n"]
    within = np.bincount(np.concatenate(at), minlength=len(vocab))  # passages that hold a shingle
    idf = (np.log((1 + total) / (1 + df)) + 0.1) * (np.log((1 + len(cells)) / (1 + within)) + 0.1)
    weights = [n * idf[f] for f, (_, _, n) in zip(at, cells)]
    matrix = spark.createDataFrame(
        [(i, f.tolist(), (w / max(np.sqrt((w**2).sum()), 1e-12)).tolist()) for i, (f, w) in enumerate(zip(at, weights))], "id bigint, features array<bigint>, weights array<double>"
    ).repartition(-(-len(cells) // 4096))
    rank = max(1, min(rank, len(cells) // 4))
    left, sigma, right = randomised_svd(matrix, rank, max(4, rank // 4))
    places, turn = np.zeros((len(cells), len(sigma))), np.zeros((len(vocab), len(sigma)))
    for r in left.toLocalIterator():
        places[r["id"]] = r["factor"]
    for r in right.toLocalIterator():
        turn[r["feature"]] = r["factor"]
    space = spark.sparkContext.broadcast(Space(held, vocab, idf, turn, sigma, places * sigma, owner, probes))

    def search(batches):
        sp = space.value
        for b in batches:
            rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()))
            z, of = [], []
            for d, (_, chars, _) in enumerate(rows):
                h, half, weight = _cells(chars, window)
                pos, f = lookup(sp.vocab, sp.bits, h)
                for w in _windows(half[pos], weight[pos], least):
                    i, j = np.searchsorted(half[pos], [w, w + 2])
                    z.append(sp.project[f[i:j]].sum(0))
                    a, e = np.searchsorted(half, [w, w + 2])
                    of.append((d, int(a), int(e)))
            best: dict = {}
            if z:
                for r, i, c in zip(*(x.tolist() for x in sp.candidates(np.asarray(z), cosine))):
                    d = of[r][0]
                    if (d, i) not in best or best[d, i][0] < c:
                        best[d, i] = c, r
            out, starts_of = [], {}
            for (d, i), (c, r) in best.items():
                k, chars, packed = rows[d]
                if d not in starts_of:
                    starts_of[d] = np.unpackbits(np.frombuffer(packed, np.uint8), count=len(chars) + 1).astype(bool)
                starts, it = starts_of[d], sp.items[i]
                _, a, e = of[r]
                if it.han:
                    here = list(chars[a:e])
                else:
                    cut_at = a + np.flatnonzero(starts[a : e + 1])
                    here = [chars[x:y] for x, y in zip(cut_at, cut_at[1:])]
                common = lcs(here, it.parts())
                stretch = it.found(chars, starts)
                if stretch or common >= max(min_chars if it.han else min_words, share * len(here)):
                    out.append((k, it.key, "stretch" if stretch else "paraphrase", float(c), common, bool(it.last) and it.last in chars))
            cols = list(zip(*out)) if out else [[]] * 6
            kinds = [b.schema.field(0).type, kind_of[item_kind], pa.string(), pa.float64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds)], ["key", "item", "kind", "cosine", "common", "answered"])

    return once.where("feature IS NULL").select("key", "chars", "starts").mapInArrow(search, f"key {key_kind}, item {item_kind}, kind string, cosine double, common bigint, answered boolean")

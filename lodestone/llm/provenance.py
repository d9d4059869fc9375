"""Source files that people did not write by hand as part of their repository.

Every file becomes a stream of tokens in which identifiers are masked, with keywords kept. It is read at
two levels: ``body`` keeps the literals, ``shape`` masks them by their kind as well. At each level the
distinct five-token shingles get a MinHash signature; any two files that share a band of it are candidates,
and unless they are linked already their shingle sets are compared exactly. Clusters are what verified links
connect. What they are follows from them:

* a cluster of bodies over several repositories is third-party code (``vendored``);
* a cluster of shapes that repeat few statements again and again is what a generator gives out, in one
  repository or in several that use it (``generated``), or what a minifier does, if its lines are endless
  (``minified``);
* a cluster of shapes that are bulk literals and little else is a ``blob``.

A file that no cluster holds can only be told by what it shares with those of the clusters: every
four-word shingle of the lines of comment at its head, and every folder and part of its name, is counted over all
files, and those that are borne by cluster members far more than by others speak for the rest
(``marked``). No list of words, folders or names is given; the marks are what the clusters say they are.
"""

from __future__ import annotations

import keyword
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..session import cut, spread

_TOKEN = re.compile(
    r"//[^\n]*|/\*[\s\S]*?\*/|\#[^\n]*|\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[^\W\d]\w*|\d[\w.]*|[^\s\w]"
)
_LEADING = re.compile(r"(?:\s++|\#[^\n]*+|//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/)*+")
_HEAD_WORD = re.compile(r"[^\W_][\w.@+-]*")
_NAME_PART = re.compile(r"[^\W_]+")

#: The reserved words of the languages; all other words are identifiers.
KEYWORDS = frozenset(keyword.kwlist) | frozenset(
    "abstract as async await break case catch class const continue debugger declare default delete do else enum export extends false finally for from function get "
    "if implements import in instanceof interface let namespace new null of private protected public readonly return set static super switch this throw true try "
    "type typeof undefined var void while with yield".split()
)
#: Values of a signature; those of a band of candidates (38 bands: of pairs at a similarity of 0.8, 3 in ten
#: million share none) and of a band of leaders (24 bands).
HASHES, ROWS, LEAD_ROWS, SHINGLE = 192, 5, 8, 5
#: Words of 64 bits of the parities that go with every band.
WORDS = 8
_RNG = np.random.default_rng(20240607)
_MUL = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_POW = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(SHINGLE)], dtype=np.uint64)
COMMENT, WORD, NUMBER, TEXT, MARK = range(5)
#: Shapes of the shape level: what is left of a literal.
_NUMBER_SHAPE, _TEXT_SHAPE = np.uint64(8 | NUMBER), np.uint64(8 | TEXT)


class _Ids(dict):
    """Token -> a stable number whose low three bits are its kind; identifiers share one number."""

    def __missing__(self, t):
        c = t[0]
        if c == "#" or t[:2] in ("//", "/*") or t[:3] in ('"""', "'''"):
            found = COMMENT
        elif (c.isalpha() or c == "_") and t not in KEYWORDS:
            found = 8 | WORD
        else:
            kind = TEXT if c in "\"'" else NUMBER if c.isdigit() else MARK
            found = (zlib.crc32(t.encode("utf-8", "surrogatepass")) + 2) << 3 | kind
        if len(self) > 300_000:
            self.clear()
        self[t] = found
        return found


_IDS = _Ids()


def masked(text: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Numbers and lengths of the tokens that are not comments, and all token texts."""
    tokens = _TOKEN.findall(text)
    ids = np.fromiter(map(_IDS.__getitem__, tokens), np.uint64, len(tokens))
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    code = (ids & np.uint64(7)) != COMMENT
    return ids[code], sizes[code], tokens


def shape_of(ids: np.ndarray) -> np.ndarray:
    """The stream with literals masked by their kind."""
    kinds = ids & np.uint64(7)
    return np.where(kinds == NUMBER, _NUMBER_SHAPE, np.where(kinds == TEXT, _TEXT_SHAPE, ids))


def shingles(ids: np.ndarray) -> np.ndarray:
    """The distinct hashed five-token shingles of a masked token stream (of all of it, if shorter)."""
    if len(ids) == 0:
        return np.empty(0, np.uint64)
    k = min(SHINGLE, len(ids))
    n = len(ids) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h += (ids[i : i + n] ^ (ids[i : i + n] << np.uint64(21))) * _POW[i]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def signature(hashes: np.ndarray) -> np.ndarray:
    """MinHash values of a set of shingles."""
    out = np.empty(HASHES, np.uint64)
    for i in range(0, HASHES, 32):
        out[i : i + 32] = (hashes[None, :] * _MUL[i : i + 32, None] + _ADD[i : i + 32, None]).min(axis=1)
    return out ^ (out >> np.uint64(23))


def bands(sig: np.ndarray, size: int) -> np.ndarray:
    """One number per band of ``size`` values of a signature."""
    n = len(sig) // size
    rows = sig[: n * size].reshape(n, size)
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = (h ^ rows[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def parities(hashes: np.ndarray) -> bytes:
    """For each of 512 or more classes of shingles (three for four shingles), whether their number is odd.
    Two sets differ in at least as many shingles as their parities in places."""
    m = 64 * WORDS
    while 4 * m < 3 * len(hashes):
        m *= 2
    return np.packbits((np.bincount((hashes & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8)).tobytes()


def _folded(bits: bytes, size: int) -> np.ndarray:
    """Parities of fewer classes, as 64-bit words."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint64).reshape(-1, size), axis=0)


def head(text: str) -> str:
    """The comments before the first code, whatever their length."""
    return _LEADING.match(text)[0]


def features(path: str, text: str) -> list[str]:
    """What a file says of itself: the four-word shingles of the lines of its head (of a shorter line, all
    of it), with the line's begin and end as words, file names and words with digits masked; its folders below
    the repository; the inner parts of its name."""
    out = set()
    for line in head(text).split("\n"):
        words = [w if w.replace("-", "").isalpha() else "#" for w in (x.lower().strip(".-+@") for x in _HEAD_WORD.findall(line))]
        if words:
            words = ["^", *words, "$"]
            out.update("head " + " ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3)))
    *folders, name = path.replace("\\", "/").split("/")
    out.update("folder " + f.lower() for f in folders[1:])
    out.update("name " + re.sub(r"\d.*", "#", w.lower()) for w in _NAME_PART.findall(name)[1:-1])
    return sorted(out)


def literal_bulk(ids: np.ndarray, sizes: np.ndarray, tokens: list[str]) -> int:
    """Characters of literals, if the file is literals and little else: seven tenths of its characters, and
    one word in eight tokens at most or one unbroken literal that makes most of it. Else 0."""
    kinds = ids & np.uint64(7)
    literal = int(sizes[(kinds == NUMBER) | (kinds == TEXT)].sum())
    size = int(sizes.sum())
    if not size or literal < 0.7 * size:
        return 0
    words = (kinds == WORD) | ((kinds == MARK) & (sizes > 1))
    if words.sum() <= len(ids) / 8 or any(len(t) >= 0.6 * size and t[0] in "\"'" and " " not in t for t in tokens):
        return literal
    return 0


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


_PRINT = {
    "path": "string", "repo": "string", "version": "bigint", "kind": "string",
    "shape_set": "binary", "shape_digest": "bigint", "shapes": "bigint", "shape": "binary", "shape_lead": "binary", "shape_bits": "binary",
    "bodies": "bigint", "body_digest": "bigint", "body": "binary", "body_lead": "binary", "body_bits": "binary", "features": "array<bigint>",
}
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}


def _signed(b: bytes) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(b)).astype(np.int64))


def _digest(text: str) -> int:
    return _signed(text.encode("utf-8", "surrogatepass"))


def fingerprints(
    files: DataFrame, path: str = "path", repo: str = "repo", content: str = "content", evidence: int = 150, few: int = 100, repeats: int = 8, wide: int = 50, bulk: int = 2500
) -> DataFrame:
    """One row per path and version of its content, in one read. ``kind`` is what a cluster of such shapes
    would be (null: nothing); files that have one get the set of their shapes. ``bodies`` is the number of
    distinct body shingles. The sets of shapes and those of ``evidence`` bodies or more get a digest, two
    rows of bands and their parities. ``features`` are hashed."""
    data = files.where(F.col(content).isNotNull() & F.col(path).isNotNull()).select(F.col(path).alias("path"), F.col(repo).alias("repo"), F.col(content).alias("content"))

    def one(p, r, c):
        c = c.replace("\r\n", "\n")
        ids, sizes, tokens = masked(c)
        body, shape = shingles(ids), shingles(shape_of(ids))
        lines = max(1, sum(1 for x in c.split("\n") if x and not x.isspace()))
        if literal_bulk(ids, sizes, tokens) >= bulk:
            kind = "blob"
        elif len(ids) >= wide * lines and len(body) >= evidence:
            kind = "minified"
        elif len(ids) >= few and len(shape) <= few and len(ids) >= repeats * len(shape):
            kind = "generated"
        else:
            kind = None
        shaped = (shape.tobytes(), _signed(shape.tobytes()), len(shape), *sketched(shape)) if kind else (None,) * 6
        bodied = (_signed(body.tobytes()), *sketched(body)) if len(body) >= evidence else (None,) * 4
        return p, r if r is not None else p.split("/")[0], _digest(c), kind, *shaped, len(body), *bodied, [_digest(f) for f in features(p, c)]

    def sketched(hashes):
        sig = signature(hashes)
        return bands(sig, ROWS).tobytes(), bands(sig, LEAD_ROWS).tobytes(), parities(hashes)

    def run(batches):
        for b in batches:
            rows = [one(*x) for x in zip(_column(b, "path"), _column(b, "repo"), _column(b, "content"))]
            cols = list(zip(*rows)) if rows else [[]] * len(_PRINT)
            yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(cols, _PRINT.values())], list(_PRINT))

    got = spread(data).mapInArrow(run, ", ".join(f"{n} {t}" for n, t in _PRINT.items()))
    return got.dropDuplicates(["path", "version"]).withColumn("id", F.monotonically_increasing_id())


def _numbered(column: list) -> np.ndarray:
    """The bands of all rows, with their place in the upper half."""
    keys = np.frombuffer(b"".join(column), np.uint32).astype(np.int64).reshape(len(column), -1)
    return keys | (np.arange(keys.shape[1], dtype=np.int64) << 32)


def leaders(known: DataFrame) -> DataFrame:
    """``leader, id``: the members of each bucket of ``lead`` with its least and its greatest id. It only
    saves work: what it links need not be compared by ``candidates``."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                keys = _numbered(_column(b, "lead"))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(_column(b, "id"), np.int64), keys.shape[1])), pa.array(keys.ravel())], ["id", "band"])

    keyed = known.select("id", "lead").mapInArrow(run, "id bigint, band bigint")
    ends = keyed.groupBy("band").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    met = keyed.join(ends, "band").select("id", F.explode(F.array("first", "last")).alias("leader"))
    return met.where("leader <> id").select("leader", "id").distinct()


def candidates(known: DataFrame, similarity: float) -> DataFrame:
    """``leader, id``: all pairs of different ``label`` that share a band and that neither their sizes nor
    their parities exclude (which no pair of the similarity does). The parities go with the bands, so that
    only what is left of the pairs is shuffled."""
    words = [f"w{i}" for i in range(WORDS)]

    def run(batches):
        for b in batches:
            if b.num_rows:
                keys = _numbered(_column(b, "bands"))
                bits = np.array([_folded(x, WORDS) for x in _column(b, "bits")]).view(np.int64)
                cols = [keys.ravel(), *(np.repeat(x, keys.shape[1]) for x in (*(np.asarray(_column(b, c), np.int64) for c in ("id", "label", "n")), *bits.T))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["band", "id", "label", "n", *words])

    keyed = known.select("id", "label", "n", "bands", "bits").mapInArrow(run, ", ".join(f"{c} bigint" for c in ("band", "id", "label", "n", *words)))
    x, y = keyed.alias("x"), keyed.alias("y")
    differ = sum((F.bit_count(F.col(f"x.{w}").bitwiseXOR(F.col(f"y.{w}"))) for w in words[1:]), F.bit_count(F.col("x.w0").bitwiseXOR(F.col("y.w0"))))
    apart = (F.col("x.id") < F.col("y.id")) & (F.col("x.label") != F.col("y.label"))
    sized = _sized(F.col("x.n"), F.col("y.n"), similarity)
    met = x.join(y, (F.col("x.band") == F.col("y.band")) & apart & sized & (differ <= _room(F.col("x.n") + F.col("y.n"), similarity)))
    return met.select(F.col("x.id").alias("leader"), F.col("y.id").alias("id")).distinct()


def _sized(x, y, similarity: float):
    return F.least(x, y) >= F.greatest(x, y) * similarity - 1e-6


def _room(size, similarity: float):
    """How many shingles two sets of together ``size`` may differ in (with room for rounding)."""
    return size * ((1 - similarity) / (1 + similarity)) + 1e-6


def _sided(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs with the columns of both ends; those of the leader are named ``leader_...``."""
    lead = known.select(*[F.col(c).alias("leader" if c == "id" else f"leader_{c}") for c in known.columns])
    return pairs.join(known, "id").join(lead, "leader")


def _where(pairs: DataFrame, test, *columns: str) -> DataFrame:
    """``leader, id`` of the pairs whose ``columns`` (as arrays of each end) pass the test."""

    def run(batches):
        for b in batches:
            keep = pa.array([bool(test(*x)) for x in zip(*(_column(b, c) for c in columns))], pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(_column(b, n), pa.int64()).filter(keep) for n in ("leader", "id")], ["leader", "id"])

    return pairs.mapInArrow(run, "leader bigint, id bigint")


def _alike(similarity: float):
    def test(x, y):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= similarity * (len(x) + len(y) - both)

    return test


def _body_sets(files: DataFrame, wanted: DataFrame, path: str, content: str, small: int) -> DataFrame:
    """``id, set`` of the files ``wanted`` (``id, path, version``), read again. Up to ``small`` of them are
    broadcast, so that contents stay where they are; more are joined by a shuffle."""
    data = files.where(F.col(content).isNotNull()).select(F.col(path).alias("path"), F.col(content).alias("content"))
    data = data.join(F.broadcast(wanted) if wanted.count() <= small else wanted, "path")

    def run(batches):
        for b in batches:
            keep, out = [], []
            for i, v, c in zip(_column(b, "id"), _column(b, "version"), _column(b, "content")):
                c = c.replace("\r\n", "\n")
                if _digest(c) == v:
                    keep.append(i)
                    out.append(shingles(masked(c)[0]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(out, pa.binary())], ["id", "set"])

    return data.mapInArrow(run, "id bigint, set binary").dropDuplicates(["id"])


def _clusters(known: DataFrame, similarity: float, verified) -> DataFrame:
    """``leader, id``: the members of each cluster of two or more, with its least id. ``known`` has ``id,
    digest, n, bands, lead, bits``; ``verified`` keeps the pairs whose sets are alike. Sets of equal digests are
    equal; one of each takes part in the search. First all meet the leaders of their buckets; whatever shares a
    leader is connected and takes its label. Then all pairs of different labels are compared."""
    twins = cut(known.select("id", "digest").join(known.groupBy("digest").agg(F.min("id").alias("leader")), "digest").select("leader", "id"))
    one = cut(known.join(twins.where("leader = id").select("id"), "id", "left_semi"))
    ends = one.select("id", "n", "bits")

    def alike(n, m, x, y):
        size = min(len(x), len(y)) // 8
        return int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum()) <= _room(n + m, similarity)

    def kept(pairs):
        return cut(verified(_where(_sided(pairs, ends).where(_sized(F.col("n"), F.col("leader_n"), similarity)), alike, "n", "leader_n", "bits", "leader_bits")))

    first = kept(leaders(one))
    label = one.join(first.groupBy("id").agg(F.min("leader").alias("label")), "id", "left").withColumn("label", F.least("id", "label"))
    links = first.union(kept(candidates(label, similarity))).union(twins.where("leader <> id").select("leader", "id"))
    return components(links.toDF("src", "dst")).select(F.col("component").alias("leader"), F.col("node").alias("id"))


def _level(prints: DataFrame, level: str, n: str) -> DataFrame:
    named = prints.where(F.col(level).isNotNull())
    return named.select("id", F.col(f"{level}_digest").alias("digest"), F.col(n).alias("n"), F.col(level).alias("bands"), F.col(f"{level}_lead").alias("lead"), F.col(f"{level}_bits").alias("bits"))


def shape_clusters(prints: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``leader, id``: the members of each cluster of shapes, connected by pairs of ``similarity``."""
    sets = prints.select("id", F.col("shape_set").alias("set"))
    return _clusters(_level(prints, "shape", "shapes"), similarity, lambda pairs: _where(_sided(pairs, sets), _alike(similarity), "set", "leader_set"))


def body_clusters(files: DataFrame, prints: DataFrame, similarity: float = 0.8, path: str = "path", content: str = "content", small: int = 100_000) -> DataFrame:
    """``leader, id``: the members of each cluster of bodies, connected by pairs of ``similarity``. The sets
    of pairs that their parities do not exclude are made from the files again."""

    def verified(pairs):
        pairs = cut(pairs)
        sides = pairs.select(F.col("leader").alias("id")).union(pairs.select("id")).distinct().join(prints.select("id", "path", "version"), "id")
        return _where(_sided(pairs, _body_sets(files, sides, path, content, small)), _alike(similarity), "set", "leader_set")

    return _clusters(_level(prints, "body", "bodies"), similarity, verified)


def not_hand_written(
    files: DataFrame, path: str = "path", repo: str = "repo", content: str = "content", similarity: float = 0.8,
    evidence: int = 150, few: int = 100, repeats: int = 8, wide: int = 50, bulk: int = 2500, votes: int = 4, share: float = 0.2,
) -> DataFrame:
    """One row per file that people did not write by hand as part of its repository: ``path``, ``reasons``
    (sorted, of ``blob generated marked minified vendored``), ``repos`` and ``copies`` (of the largest
    cluster that holds it; 1 where none does).

    What a cluster must show, whatever the number of files: bodies of ``evidence`` distinct shingles or more
    over two repositories or more (less agrees by chance, as headers of imports and small components do) for ``vendored``; at most
    ``few`` distinct shapes that stand for ``repeats`` tokens each or more for ``generated``; ``wide`` tokens
    a line for ``minified``; ``bulk`` characters of literals and little else for ``blob`` (small tables are
    kept by hand). A feature is a mark if at least ``votes`` different texts bear it and clusters hold the
    share ``share`` of them or more; copies of one text are one vote.

    Repeated rows count once; of a path with several contents each version takes part, and the path is given
    if one of them is found. Files with a null path or content and files without code join no cluster; marks
    may still tell the latter. Null repositories are the first folder of the path."""
    prints = cut(fingerprints(files, path, repo, content, evidence, few, repeats, wide, bulk))
    bodies = body_clusters(files, prints, similarity, path, content).withColumn("level", F.lit("body"))
    members = cut(bodies.union(shape_clusters(prints, similarity).withColumn("level", F.lit("shape"))))
    known = prints.select("id", "repo", "kind")
    # members are counted by repository first, so that a hot cluster is no single task
    per_repo = members.join(known, "id").groupBy("level", "leader", "repo").agg(F.count("*").alias("n"))
    size = per_repo.groupBy("level", "leader").agg(F.count("*").alias("repos"), F.sum("n").alias("copies"))
    body = F.col("level") == "body"
    said = members.join(size, ["level", "leader"]).join(known, "id").groupBy("id").agg(
        F.max("repos").alias("repos"),
        F.max("copies").alias("copies"),
        F.min(F.when(body, F.col("leader"))).alias("unit"),
        F.max(body & (F.col("repos") > 1)).alias("vendored"),
        *[F.max(~body & (F.col("kind") == k)).alias(k) for k in ("blob", "minified", "generated")],
    )
    kinds = ("blob", "generated", "minified", "vendored")
    judged = cut(
        prints.select("id", "path", "features").join(said, "id", "left")
        .withColumn("unit", F.coalesce("unit", "id"))
        .withColumn("held", F.coalesce(F.greatest(*kinds), F.lit(False)))
    )
    borne = judged.select("id", "unit", "held", F.explode("features").alias("feature"))
    texts = borne.groupBy("feature", "unit").agg(F.max("held").alias("held"))
    marks = texts.groupBy("feature").agg(F.count("*").alias("n"), F.count_if("held").alias("hits")).where((F.col("n") >= votes) & (F.col("hits") >= share * F.col("n")))
    marked = borne.where(~F.col("held")).join(marks.select("feature"), "feature").select("id").distinct().withColumn("marked", F.lit(True))
    out = judged.join(marked, "id", "left").withColumn("marked", F.coalesce("marked", F.lit(False)))
    per_path = out.groupBy("path").agg(*[F.coalesce(F.max(k), F.lit(False)).alias(k) for k in (*kinds, "marked")], F.max("repos").alias("repos"), F.max("copies").alias("copies"))
    reasons = F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in sorted((*kinds, "marked"))]))
    one = F.lit(1).cast("bigint")
    return per_path.select("path", reasons.alias("reasons"), F.coalesce("repos", one).alias("repos"), F.coalesce("copies", one).alias("copies")).where(F.size("reasons") > 0)

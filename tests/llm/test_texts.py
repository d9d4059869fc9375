import random

import pytest

from lodestone.llm import leakage, packing, provenance, segment, sentences
from lodestone.llm import queries as Q


def spans(text):
    return [text[a:b] for a, b in sentences.sentences(text)]


def test_sentences():
    assert spans('Mr. Vane wrote that "x 8.2 is empty." The U.S. mirror, e.g. 3 copies, etc. and more.') == ['Mr. Vane wrote that "x 8.2 is empty."', "The U.S. mirror, e.g. 3 copies, etc. and more."]
    assert spans('He asked "Done?" and left. Nobody knows where it went... iOS clients wait ... then stop.') == ['He asked "Done?" and left.', "Nobody knows where it went...", "iOS clients wait ... then stop."]
    assert spans("他问：“停止了吗？”然后关闭。“已丢失。”作者说“很稳定。它不丢失”，但不是。") == ["他问：“停止了吗？”然后关闭。", "“已丢失。”", "作者说“很稳定。它不丢失”，但不是。"]
    assert spans("「壊れました。」と表示された。「不要です。」") == ["「壊れました。」と表示された。", "「不要です。」"]
    assert spans("Seit dem 3. Oktober vor dem 12. Lauf. Er fragte: „Fertig?“ und ging, z. B. heute.") == ["Seit dem 3. Oktober vor dem 12. Lauf.", "Er fragte: „Fertig?“ und ging, z. B. heute."]
    assert spans("M. A a dit : « Vide ? » avant. « Perdu. » Oui !") == ["M. A a dit : « Vide ? » avant.", "« Perdu. »", "Oui !"]
    assert spans("# Title here\n\n* one item. two\n* second\n\n1. x\n2. y\n\n> quoted text\n> goes on. Next") == ["Title here", "one item. two", "second", "x", "y", "quoted text\n> goes on.", "Next"]
    assert spans("Some were hidden on Jan.\n5. Do not edit.") == ["Some were hidden on Jan.\n5.", "Do not edit."]
    assert spans("They are:\n1. first one\n2. second") == ["They are:", "first one", "second"]
    assert spans("ระบบอ่านไฟล์ ทำไมต้อง") == ["ระบบอ่านไฟล์", "ทำไมต้อง"]
    assert spans("यह है। क्या? هل؟ نعم.") == ["यह है।", "क्या?", "هل؟", "نعم."]
    assert spans("no punctuation at\nall here\n\n  \nnext") == ["no punctuation at\nall here", "next"]
    assert sentences.sentences(None) == sentences.sentences(" \n ") == []


def test_sentences_are_linear():
    import time

    start = time.time()
    assert len(sentences.sentences("## x\n" * 10_000)) == len(sentences.sentences("- an item\n" * 10_000)) == 10_000
    for text in ("(a " * 50_000, '"a ' * 50_000, "«a „b 3. c " * 30_000, "1. " * 50_000, "word\n1. an item that is rather long and wrapped\n" * 10_000, "x" * 500_000, "..." * 50_000):
        assert sentences.sentences(text)
    assert time.time() - start < 20


def test_list_levels():
    got = [(t[2], "1. a\n   - b\n     goes on\n   - c\n2. d\n7. no mark"[t[0] : t[1]]) for t in sentences.leveled("1. a\n   - b\n     goes on\n   - c\n2. d\n7. no mark")]
    assert got == [(1, "a"), (2, "b\n     goes on"), (2, "c"), (1, "d\n7. no mark")]
    assert sentences.leveled("Prose here. More.") == [(0, 11, 0), (12, 17, 0)]


@pytest.mark.parametrize("seed", range(30))
def test_sentence_spans_are_ordered(seed):
    random.seed(seed)
    t = "".join(random.choice('ab .!?\n"“”「」«»()。，# *>1A') for _ in range(300))
    last = 0
    for a, b in sentences.sentences(t):
        assert last <= a < b and t[a:b] == t[a:b].strip()
        last = b


@pytest.mark.parametrize("seed", range(25))
def test_pieces_cover_the_text(seed):
    random.seed(seed)
    t = "\n".join("".join(random.choice("abc d.。") for _ in range(random.choice([0, 5, 60, 700, 2000, 5000]))) for _ in range(random.randint(1, 30)))
    got, long_lines = segment.pieces(t)
    assert long_lines == [i for i, x in enumerate(t.split("\n"), 1) if len(x) > 2000]
    assert got[0][0] == 0 and got[-1][1] >= len(t.rstrip("\n"))
    for (a, b), (c, d) in zip(got, got[1:]):
        assert b - c <= 200 and c <= b + 1 and d > b and d - c <= 2000
        assert t[b:c].strip("\n") == ""
    at = 0
    for line in t.split("\n"):
        if len(line) <= 2000:
            assert any(a <= at and at + len(line) <= b for a, b in got)
        at += len(line) + 1


def test_pieces_are_linear_in_the_lines():
    import time

    start = time.time()
    for text in ("\n".join(["value one two three"] * 100_000), "\n" * 100_000 + "x", "x" * 2_000_000, "\n".join(f"w{i} w{i // 3}" for i in range(100_000))):
        got, _ = segment.pieces(text)
        assert all(0 <= b - c <= 200 and d - c <= 2000 for (_, b), (c, d) in zip(got, got[1:]) if b > c)
    assert time.time() - start < 20


def test_pieces_end_at_the_deepest_valley():
    first, second = ("red green blue yellow\n" * 30).strip(), ("iron copper zinc silver\n" * 90).strip()
    got, _ = segment.pieces(first + "\n" + second)
    assert got[0][1] == len(first)


def test_pieces_overlap():
    got, _ = segment.pieces("x" * 9000)
    assert all(199 <= b - c <= 200 for (_, b), (c, _) in zip(got, got[1:]))


def test_split_operator(spark):
    rows = [(1, "x " * 4000, 10, "e"), (1, "x " * 4000, 10, "e"), (2, "short\ntext", None, "e"), (3, None, 0, None), (None, "y " * 4000, 1, "e"), (4, "", 1, "e")]
    df = spark.createDataFrame(rows, "chunk_id long, text string, start_line int, piece string")
    got = segment.split_oversized(df).collect()
    assert sorted({r["chunk_id"] for r in got if r["chunk_id"]}) == [1, 2, 3, 4] and sum(r["chunk_id"] is None for r in got) == 1
    assert [(r["start_line"], r["end_line"]) for r in got if r["chunk_id"] == 2] == [(1, 2)]
    assert sum(r["chunk_id"] == 1 for r in got) > 3
    assert segment.split_oversized(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_a_packing(seed):
    random.seed(seed)
    h = {random.randint(1, 64): random.randint(1, 50) for _ in range(random.randint(0, 40))}
    placed, n = packing.plan(h, 64)
    load: dict = {}
    seen = dict.fromkeys(h, 0)
    for s, first, m, per, c, at in placed:
        assert first == seen[s]
        seen[s] += m
        for r in range(m):
            load.setdefault(c + r // per, []).append((at + r % per * s, s))
    assert seen == h and sorted(load) == list(range(n))
    for v in load.values():
        v.sort()
        assert v[-1][0] + v[-1][1] <= 64 and all(a + s <= b for (a, s), (b, _) in zip(v, v[1:]))
        assert sum(3 * s > 64 for _, s in v) <= 2


def test_containers(spark):
    rows = [(i, "word " * random.Random(i).randint(0, 900)) for i in range(300)] + [(900, "word " * 5000), (901, None), (902, ""), (0, "dup"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "tokens")
    got = packing.fill_containers(df, capacity=512, salts=4).collect()
    assert {r["doc_id"] for r in got} == {r[0] for r in rows if r[0] is not None}
    assert sum(r["doc_id"] == 900 for r in got) > 1 and all(r["offset"] + r["tokens"] <= 512 for r in got)
    by: dict = {}
    for r in got:
        if r["tokens"]:
            by.setdefault(r["container"], []).append((r["offset"], r["tokens"]))
    for v in by.values():
        v.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(v, v[1:]))
    assert sorted(by) == list(range(len(by)))
    assert packing.fill_containers(df.limit(0)).count() == 0


ITEM = "Whenever a caller asks the quovex route for felkel, the gristi planner answers with 42 hovmur hops & stops before it closes the lomzim table"


def test_leaks(spark):
    wide = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in ITEM.upper())
    docs = [
        (1, "Before. " + ITEM + " After."), (2, "> " + ITEM.replace(" ", "\n> ", 6)), (3, ITEM.replace("&", "&amp;").replace("quovex", "<b>quo\u200bvex</b>")), (4, wide), (5, " ".join(ITEM.split()[:11]) + " other"),
        (6, " ".join(ITEM.split()[5:17])), (7, None), (8, ""), (9, "与霁熠熠不同霁瑾霖索引只保存霖霁芷的摘要因此重建瑾芷澄"), (10, "与霁熠熠不同霁瑾霖索引只保存霖霁芷的摘"), (1, "Before. " + ITEM), (11, "**" + ITEM.replace(" ", "** __") + "__"),
    ]
    items = [(1, "en", ITEM), (2, "zh", "与霁熠熠不同，霁瑾霖索引只保存霖霁芷的摘要，因此重建瑾芷澄"), (3, "en", None), (4, "en", "too short"), (5, "en", "Unlike others, " + ITEM)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    e = spark.createDataFrame(items, "item_id long, lang string, text string").selectExpr("*", "'s' AS suite")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(d, e).collect()}
    assert got == {(k, i) for k in (1, 2, 3, 4, 6, 11) for i in (1, 5)} | {(9, 2)}
    assert leakage.leaks(d.limit(0), e).count() == 0 and leakage.leaks(d, e.limit(0)).count() == 0
    assert {(r["doc_id"], r["item_id"]) for r in leakage.leaks(d, e, block=500).collect()} == got  # one item a block


def test_leaks_by_any_kind_of_key(spark):
    d = spark.createDataFrame([("2024-01-01", ITEM), (None, ITEM)], "doc_id string, text string").selectExpr("CAST(doc_id AS DATE) AS doc_id", "text")
    e = spark.createDataFrame([("a", None, ITEM), ("a", None, ITEM), (None, "en", ITEM)], "item_id string, lang string, text string")
    assert [(str(r["doc_id"]), r["item_id"]) for r in leakage.leaks(d, e).collect()] == [("2024-01-01", "a")]


def test_leaks_in_other_words(spark):
    words = ITEM.split()
    changed = " ".join(w for i, w in enumerate(words) if i % 9 != 5)  # no twelve words in a row are left
    d = spark.createDataFrame([(1, changed), (2, " ".join(reversed(words)))], "doc_id long, text string")
    got = leakage.leaks(d, spark.createDataFrame([(1, "en", ITEM)], "item_id long, lang string, text string")).collect()
    assert [(r["doc_id"], r["kind"]) for r in got] == [(1, "paraphrase")] and got[0]["common"] >= 12


@pytest.mark.parametrize("seed", range(20))
def test_lcs(seed):
    random.seed(seed)
    a, b = (random.choices("abcd", k=random.randint(0, 40)) for _ in range(2))
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = table[i - 1][j - 1] + 1 if x == y else max(table[i - 1][j], table[i][j - 1])
    assert leakage.lcs(a, b) == table[-1][-1]


def test_leak_search_finds_what_brute_force_finds(spark):
    d = "/root/testdata/sf0.01"
    got = {tuple(r) for r in Q.p7_found(spark, d).collect()}
    held = [leakage.Item(r[0], r[1], r[2], 12, 24) for r in spark.read.parquet(f"{d}/eval_items.parquet").select("item_id", "lang", "text").collect()]
    want = set()
    for k, t in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect():
        chars, starts = leakage.stream(t or "")
        want |= {(k, it.key) for it in held if it.found(chars, starts)}
    assert want and got == want


def _code(name, k, n=40):
    return "\n".join(f"def {name}_{i}(a_{i}):\n    return a_{i} * {i * k} + len('text number {i}')\n" for i in range(n))


def _own(i):
    random.seed(i)
    ops = ["if {0} > {1}:\n    {2} = [x for x in {0}]", "while {0}:\n    {1} -= {2}", "{0} = lambda x, y: {1}[x](y)", "with {0}({1}) as {2}:\n    pass", "assert {0} is not {1}, {2}", "{0}.{1}({2}, *{0})", "try:\n    {0}()\nexcept {1}:\n    raise {2}"]
    return "\n".join(random.choice(ops).format(*random.choices("abcdef", k=3)) for _ in range(25))


def _reasons(df):
    return {r["path"]: list(r["reasons"]) for r in provenance.not_hand_written(df).collect()}


def test_provenance(spark):
    body = _code("fun", 7919)
    numbers = lambda k: "export const A = [" + ",".join(str(i * k) for i in range(4000)) + "];"
    small = lambda k: "".join(f"function a{i}(b){{return b+{i * k}}}var c{i}=[{i},a{i}].map(x=>x?{i}:!0);" for i in range(60))
    rows = [
        ("r1/vendor/lib/a.py", "r1", body + _own(1)), ("r2/src/b.py", "r2", (body + _own(1)).replace("fun_", "gun_")), ("r3/src/b.py", "r3", _own(2)),
        ("r1/blob.js", "r1", numbers(3)), ("r2/blob.js", "r2", numbers(7)), ("r1/tab.js", "r1", "export const A = [1, 2, 3];"), ("r2/tab.js", "r2", "export const A = [4, 2, 3];"),
        ("r1/m.js", "r1", small(3)), ("r2/n.js", "r2", small(5)), ("r1/e.py", "r1", ""), ("r1/n.py", "r1", None), (None, "r1", "x"), ("r3/src/b.py", "r3", _own(2)), ("r4/empty.py", None, "# only a comment"),
    ]
    f = spark.createDataFrame(rows, "path string, repo string, content string").selectExpr("*", "1 AS tokens", "'x' AS leader", "2 AS id")
    got = _reasons(f)
    assert {p: r[0] for p, r in got.items()} == {"r1/vendor/lib/a.py": "vendored", "r2/src/b.py": "vendored", "r1/blob.js": "blob", "r2/blob.js": "blob", "r1/m.js": "minified", "r2/n.js": "minified"}
    assert provenance.not_hand_written(f.limit(0)).count() == 0


def test_families_are_clusters_of_repeated_shapes(spark):
    rows = [(f"r1/api/{x}.py", "r1", _code(x, k)) for x, k in (("pay", 7919), ("bill", 31), ("mail", 6101))] + [(f"r3/{i}.py", "r3", _own(i)) for i in range(6)]
    assert _reasons(spark.createDataFrame(rows, "path string, repo string, content string")) == {f"r1/api/{x}.py": ["generated"] for x in ("pay", "bill", "mail")}


def test_marks_are_learned_from_clusters(spark):
    licence = "".join(f"# Line {i} of a licence that says what everybody may do with these lines.\n" for i in range(300))
    banner = licence + "# Output of the stub press, see its manual.\n"
    rows = [(f"r{i}/x{i}.py", f"r{i}", banner + _code(f"f{i}", 7 + i)) for i in range(4)] + [("r9/y.py", "r9", banner + _own(1)), ("r8/z.py", "r8", "# A stub press is what this file needs.\n" + _own(2))]
    rows += [(f"r7/{i}.py", "r7", licence + _own(10 + i)) for i in range(40)]
    got = _reasons(spark.createDataFrame(rows, "path string, repo string, content string"))
    assert got == {f"r{i}/x{i}.py": ["generated"] for i in range(4)} | {"r9/y.py": ["marked"]}


@pytest.mark.parametrize("level", ["shape", "body"])
def test_clusters_find_what_brute_force_finds(spark, level):
    """Recall of the leaders' scheme: files with a verified partner, against all pairs."""
    f = spark.read.parquet("/root/testdata/sf0.01/source_files.parquet")
    prints = provenance.cut(provenance.fingerprints(f))
    found = provenance.shape_clusters(prints) if level == "shape" else provenance.body_clusters(f, prints, small=0)
    got = {r["id"] for r in found.collect()}
    text = {r["path"]: (r["content"] or "").replace("\r\n", "\n") for r in f.select("path", "content").distinct().collect()}
    sets = {}
    for r in prints.where(f"{level} IS NOT NULL").select("id", "path").collect():
        ids = provenance.masked(text[r["path"]])[0]
        sets[r["id"]] = frozenset(provenance.shingles(ids if level == "body" else provenance.shape_of(ids)).tolist())
    want = {p for p in sets if any(q != p and len(sets[p] & sets[q]) >= 0.8 * len(sets[p] | sets[q]) for q in sets)}
    assert want and len(want & got) >= 0.98 * len(want) and got <= want


def test_no_link_is_lost_to_the_leaders_of_a_bucket(spark):
    """Pairs just above the similarity among files of other families that are half like them, chains and copies."""
    random.seed(5)
    line = lambda k: f"v = w({k}, {k * 7}) + {k * 13}"
    number = iter(range(10**6, 10**7, 17))
    rows = []
    for i in range(150):
        lines = [line(k) for k in range(60)] + [line(next(number)) for _ in range(40)]
        for j in range(4 if i % 10 == 0 else 2):
            rows.append((f"r{j}/{i}.py", f"r{j}", "\n".join(lines)))
            for k in random.sample(range(0, 100, 2), random.choice((9, 10, 11))):
                lines[k] = line(next(number))
        rows += [(f"r9/{i}.py", "r9", rows[-1][2])] if i % 20 == 0 else []
    f = spark.createDataFrame(rows, "path string, repo string, content string")
    prints = provenance.cut(provenance.fingerprints(f))
    of = {r["id"]: r["path"] for r in prints.select("id", "path").collect()}
    got = {}
    for r in provenance.body_clusters(f, prints).collect():
        got.setdefault(r["leader"], set()).add(of[r["id"]])
    sets = {p: set(provenance.shingles(provenance.masked(c)[0]).tolist()) for p, _, c in rows}
    near = {p: {q for q in sets if len(sets[p] & sets[q]) >= 0.8 * len(sets[p] | sets[q])} for p in sets}
    want = set()
    for p in sets:
        group, new = {p}, {p}
        while new:
            new = set().union(*(near[q] for q in new)) - group
            group |= new
        want.add(frozenset(group))
    want = {g for g in want if len(g) > 1}
    close = [p for p in sets for q in near[p] if p < q and len(sets[p] & sets[q]) < 0.83 * len(sets[p] | sets[q])]
    assert len(close) > 50 and {len(g) for g in want} >= {2, 4, 5}
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))
    assert {p for p, r in _reasons(f).items() if "vendored" in r} == set().union(*want)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_queries_run(spark, name):
    import oracle

    d = "/root/testdata/sf0.01"
    df = Q.QUERIES[name](spark, d)
    rows = df.collect()  # all columns are evaluated
    assert rows and len(set(df.columns)) == len(df.columns)
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
    if name in Q.SQL:
        got, want, _, _ = oracle.compare(spark, oracle.connect(d), Q.QUERIES[name], Q.SQL[name], d)
        assert got == want

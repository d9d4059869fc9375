import json

import pyarrow as pa
import pytest

from lodestone.operators import shred as S


def rows(df):
    return sorted(tuple(r) for r in df.select("module_id", "class_pos", "function_pos", "arg_pos").collect())


def test_shapes_of_payloads(spark):
    data = [
        (1, json.dumps({"functions": {"name": "f", "args": "x"}})),  # lone values
        (2, json.dumps({"functions": json.dumps([{"name": "f", "args": [None, {"name": "b"}]}])})),  # a list as text
        (3, json.dumps({"classes": [None, {"name": "C", "methods": [{"name": "m", "args": []}, None, {"name": "n"}]}], "extra": [1]})),
        (4, "{broken"),
        (5, "[]"),
        (6, None),
        (7, "{}"),
        (7, "{}"),
        (8, json.dumps({"functions": [], "classes": None, "name": 5})),
    ]
    got = rows(S.shred_payloads(spark.createDataFrame(data, "module_id bigint, payload string")))
    assert got == sorted([
        (1, 0, 0, 0), (1, 0, 1, 0), (1, 0, 1, 1), (2, 0, 0, 0), (2, 0, 1, 0), (2, 0, 1, 2),
        (3, 0, 0, 0), (3, 2, 0, 0), (3, 2, 1, 0), (3, 2, 3, 0), (7, 0, 0, 0), (8, 0, 0, 0),
    ])


def test_empty_tables(spark):
    assert S.shred_payloads(spark.createDataFrame([], "module_id bigint, payload string, module string")).count() == 0


def test_levels_round_trip():
    """The tables rebuild the nested names and positions they were made of."""
    import random

    random.seed(5)
    for _ in range(50):
        fn = lambda: None if random.random() < 0.15 else {"name": f"f{random.random()}", "args": random.choice([None, [], [{"name": "a"}, None, {"name": "b"}]])}
        rec = {"functions": random.choice([None, [fn() for _ in range(random.randint(0, 4))]]), "classes": [None if random.random() < 0.2 else {"name": "c", "methods": [fn() for _ in range(random.randint(0, 3))]} for _ in range(random.randint(0, 3))]}
        want = [("module", 0, 0, 0, None)]
        for i, f in enumerate(rec["functions"] or [], 1):
            if f:
                want.append(("function", 0, i, 0, f["name"]))
                want += [("argument", 0, i, k, a["name"]) for k, a in enumerate(f["args"] or [], 1) if a]
        for c, k in enumerate(rec["classes"], 1):
            if k:
                want.append(("class", c, 0, 0, "c"))
                for i, f in enumerate(k["methods"], 1):
                    if f:
                        want.append(("function", c, i, 0, f["name"]))
                        want += [("argument", c, i, n, a["name"]) for n, a in enumerate(f["args"] or [], 1) if a]
        b = S.flatten([9, 9], [{}, rec]).to_pylist()
        got = [(r["kind"], r["class_pos"], r["function_pos"], r["arg_pos"], r["name"]) for r in b]
        assert sorted(map(str, got)) == sorted(map(str, want + [("module", 0, 0, 0, None)]))


@pytest.mark.parametrize("seed", range(20))
def test_offsets_and_records_give_the_same_rows(seed):
    """Level sequences read off Arrow offsets are those written record by record."""
    import random

    rng = random.Random(seed)
    arg = pa.struct([("name", pa.string()), ("type_annotation", pa.string()), ("default", pa.string())])
    anchor = pa.struct([("file", pa.string()), ("line", pa.int32())])
    fn = pa.struct([("name", pa.string()), ("docstring", pa.string()), ("args", pa.list_(arg)), ("returns", pa.string()), ("anchor", anchor), ("end_line", pa.int32())])
    cls = pa.struct([("name", pa.string()), ("docstring", pa.string()), ("methods", pa.list_(fn)), ("anchor", anchor), ("end_line", pa.int32())])
    schema = pa.schema([("module_id", pa.int64()), ("path", pa.string()), ("language", pa.string()), ("docstring", pa.string()), ("total_lines", pa.int32()), ("functions", pa.list_(fn)), ("classes", pa.list_(cls))])

    def value(t):
        if rng.random() < 0.2:
            return None
        if pa.types.is_list(t):
            return [value(t.value_type) for _ in range(rng.randint(0, 3))]
        if pa.types.is_struct(t):
            return {f.name: value(f.type) for f in t}
        return rng.randint(0, 9) if pa.types.is_integer(t) else rng.choice("abc")

    rows = [{f.name: value(f.type) for f in schema} | {"module_id": i} for i in range(rng.randint(1, 12))]
    batch = pa.RecordBatch.from_pylist(rows, schema=schema)
    for b, r in ((batch, rows), (batch.slice(len(rows) // 2), rows[len(rows) // 2 :])):
        if not r:
            continue
        want = S.flatten([x["module_id"] for x in r], r).to_pylist()
        got = [x for part in S.flatten_typed(b) for x in part.to_pylist()]
        key = lambda x: tuple(map(str, x.values()))
        assert sorted(got, key=key) == sorted(want, key=key)


def test_one_version_of_an_id_is_kept_whole(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/modules.parquet").where("size(functions) > 0").limit(1)
    other = d.selectExpr("module_id", "'other' AS path", *[c for c in d.columns if c not in ("module_id", "path", "functions")], "slice(functions, 1, 0) AS functions").select(d.columns)
    both = S.shred_modules(d.union(other)).collect()
    paths = {r["path"] for r in both if r["kind"] == "module"}
    assert len(paths) == 1 and any(r["kind"] == "function" and r["class_pos"] == 0 for r in both) == (paths != {"other"})

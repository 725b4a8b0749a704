"""Known answers, properties and odd cases of the operators."""

import random
import struct

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heddle.functions import linalg, machines, scalars
from heddle.operators import bitmaps, keyed, relational, sortedtable, webgraph
from heddle.sources import text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# relational


def test_project_reorders_and_repeats(spark):
    df = spark.createDataFrame([("1", "a", "x|y")], "id string, title string, genres string")
    out = relational.project(df, [1, 0, 1], ["t", "i", "t2"])
    assert out.columns == ["t", "i", "t2"] and tuple(out.first()) == ("a", "1", "a")


def test_string_order_and_filters(spark):
    df = spark.createDataFrame([(str(i),) for i in range(1, 301)] + [(None,)], "id string")
    assert [r["id"] for r in relational.top(df, ["id"], 5, descending=True).collect()] == ["99", "98", "97", "96", "95"]
    assert relational.where(df, "id", "=", "200").count() == 1
    assert relational.where(df, "id", ">", "95").count() == sum(str(i) > "95" for i in range(1, 301))
    assert relational.where(df, "id", "<", "95").count() == sum(str(i) < "95" for i in range(1, 301))


def test_top_is_not_a_full_sort(spark):
    plan = relational.top(spark.range(100).withColumn("k", F.col("id").cast("string")), ["k"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


# keyed tables


def test_upserts_equal_a_dict(spark):
    rng = random.Random(1)
    log = [(rng.choice(["", "a", "b", "c", "é"]), n, f"v{n}") for n in range(200)]
    model, firsts = {}, {}
    for k, n, v in log:
        model[k] = v
        firsts.setdefault(k, n)
    df = spark.createDataFrame(log, "k string, n long, v string")
    assert {r["k"]: (r["v"], r["inserted_at"]) for r in keyed.upsert(df, "k", "n").collect()} == {k: (v, firsts[k]) for k, v in model.items()}
    assert {r["n"] for r in keyed.put_flags(df, "k", "n").filter("inserted").collect()} == set(firsts.values())


def test_delete_only_equal_keys(spark):
    table = spark.createDataFrame([("a",), ("c",), ("e",)], "k string")
    gone = spark.createDataFrame([("b",), ("c",)], "k string")
    assert sorted(r["k"] for r in keyed.delete(table, gone, "k").collect()) == ["a", "e"]


def test_range_scan_to_the_last_key_and_misses(spark):
    table = spark.createDataFrame([(c,) for c in "acegz"], "k string")
    scan = lambda a, b: [r["k"] for r in keyed.range_scan(table, "k", a, b).collect()]
    assert scan("c", "z") == ["c", "e", "g", "z"] and scan("d", "d") == [] and keyed.get(table, "k", "d").count() == 0


@pytest.mark.parametrize("backward", [True, False])
@pytest.mark.parametrize("width", [None, 10, 1000])
def test_asof(spark, backward, width):
    rng = random.Random(2)
    keys = sorted(rng.sample(range(0, 3000), 60))
    probes = [(i, rng.randrange(-50, 3100)) for i in range(200)] + [(900, None)]
    out = keyed.asof(
        spark.createDataFrame(probes, "id long, at long"), spark.createDataFrame([(k,) for k in keys + keys], "k long"), "at", "k", backward,
        None if width is None else lambda c: F.floor(c / width),
    )
    got = {r["id"]: r["match"] for r in out.filter("at IS NOT NULL").collect()}
    for i, at in probes[:-1]:
        fit = [k for k in keys if (k <= at if backward else k >= at)]
        assert got[i] == ((max if backward else min)(fit) if fit else None)


def test_compare(spark):
    assert [one(spark, keyed.compare(F.lit(a), F.lit(b))) for a, b in (("10", "9"), ("é", "z"), ("a", "a"))] == [-1, 1, 0]


# sorted tables


def test_blocks_overflow_after_the_item(spark):
    rows = [("t", f"k{i:04d}", s) for i, s in enumerate([3990, 11, 1, 5000, 1, 4000, 1, 1])] + [("u", "a", 1)]
    got = sorted((r["table"], r["k"], r["block"]) for r in sortedtable.pack_blocks(spark.createDataFrame(rows, "`table` string, k string, size int"), "table", "k", "size").collect())
    assert [b for _, _, b in got] == [0, 0, 1, 1, 2, 2, 3, 3, 0]


def test_empty_table_has_no_blocks(spark):
    assert sortedtable.pack_blocks(spark.createDataFrame([], "t string, k string, size int"), "t", "k", "size").collect() == []


def test_fnv1(spark):
    halves = one(spark, sortedtable.fnv1(F.lit("a")))
    assert (halves["hi"] << 32 | halves["lo"]) == 0xAF63BD4C8601B7BE
    halves = one(spark, sortedtable.fnv1(F.lit("")))
    assert (halves["hi"] << 32 | halves["lo"]) == 0xCBF29CE484222325


def folded(rows, target):
    out, current = [], None
    for t, k, s in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        if (t,) != current:
            current, block, filled = (t,), 0, 0
        elif filled > target:
            block, filled = block + 1, 0
        filled += s or 0
        out.append((t or "", k, block))
    return out


@pytest.mark.parametrize("most", [100_000, 0])
def test_block_packing_in_ranges(spark, monkeypatch, most):
    """One large table over many ranges, small ones, items larger than a block, null sizes and a null table."""
    monkeypatch.setattr(sortedtable, "MOST_STARTS", most)
    rng = random.Random(4)
    rows = [("big", f"k{i:05d}", rng.choice([8, 9, 40, 150, 900])) for i in range(3000)]
    rows += [(f"t{i % 9}", f"k{i:05d}", rng.choice([0, 8, 20, None])) for i in range(100)] + [(None, f"k{i}", 30) for i in range(9)]
    df = spark.createDataFrame(rows, "t string, k string, s long")
    for target in (100, 400):
        got = sortedtable.pack_blocks(df, "t", "k", "s", target)
        assert sorted((r["t"] or "", r["k"], r["block"]) for r in got.collect()) == folded(rows, target)
    assert sortedtable.pack_blocks(df.limit(0), "t", "k", "s").collect() == []


def test_entries_of_a_range_fit_every_block_before_it():
    rng = random.Random(5)
    for _ in range(200):
        sizes, target = [rng.choice([0, 1, 3, 7, 30]) for _ in range(rng.randint(1, 30))], rng.randint(1, 25)
        limits, begun, last = sortedtable.entries(np.array(sizes), target)
        for held in range(2 * target + 5):
            filled, number = held, 0
            for s in sizes:
                if filled > target:
                    filled, number = 0, number + 1
                filled += s
            j = next((j for j, limit in enumerate(limits) if held > limit), None)
            assert (number, filled) == ((0, held + sum(sizes)) if j is None else (begun[j], last[j]))


def test_bloom_sizes(spark):
    assert [one(spark, sortedtable.bloom_bits(F.lit(n))) for n in (0, 1, 6, 7, 500)] == [64, 64, 64, 128, 5056]
    assert [sortedtable.bloom_hashes(b) for b in (1, 10, 100)] == [1, 6, 30]


def test_sorted_files_answer_point_and_range(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i:05d}", "v") for i in random.Random(0).sample(range(5000), 1000)], "k string, v string")
    sortedtable.write_sorted(df, "k", str(tmp_path / "t"), 3)
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 1000 and keyed.range_scan(back, "k", "k00000", "k99999").count() == 1000
    plan = keyed.get(back, "k", "k00001")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,k00001)" in plan


# bitmaps


@settings(max_examples=8, deadline=None)
@given(st.sets(st.integers(0, 200_000), max_size=60), st.sets(st.integers(0, 200_000), max_size=60), st.integers(0, 5))
def test_bitmap_algebra_and_runs(spark, a, b, dense):
    a = a | set(range(dense * 310, dense * 310 + 31 * dense))
    frame = lambda s: spark.createDataFrame([(x,) for x in s] + [(x,) for x in s], "x long")
    total = lambda bm: sum(r["members"] for r in bitmaps.cardinality(bm).collect())
    fa, fb = bitmaps.build(frame(a), "x"), bitmaps.build(frame(b), "x")
    assert total(bitmaps.union(fa, fb)) == len(a | b) and total(bitmaps.intersect(fa, fb)) == len(a & b)
    coded = bitmaps.runs(bitmaps.groups(frame(a), "x"))
    assert {r["x"] for r in bitmaps.decode(coded).collect()} == a
    for width in (63,):
        assert {r["x"] for r in bitmaps.decode(bitmaps.runs(bitmaps.groups(frame(a), "x", width), width, 50), width).collect()} == a


def test_containers(spark):
    df = spark.range(0, 70_000).withColumn("x", F.when(F.col("id") < 65_536, F.col("id")).otherwise(F.col("id") * 2))
    got = {r["bucket"]: (r["entries"], r["kind"]) for r in bitmaps.containers(df, "x").collect()}
    assert got == {0: (65_536, "bitmap"), 2: (4_464, "bitmap")}


# links


@pytest.mark.parametrize(
    "link, want",
    [
        ("https://o.org/x", "https://o.org/x"),
        ("http://o.org/http", "https://o.org/http"),
        ("//cdn.org/a", "https://cdn.org/a"),
        ("/doc", "https://s.org/doc"),
        ("sub/p", "https://s.org/page/sub/p"),
        ("#top", "https://s.org/page/#top"),
    ],
)
def test_url_rules(spark, link, want):
    assert one(spark, webgraph.absolute(F.lit(link), F.lit("https://s.org/page/"), F.lit("https://s.org"))) == want


def test_extensions_and_mirror(spark):
    keep = lambda u: one(spark, webgraph.followed(F.lit(u)))
    assert [keep(u) for u in ("https://s/a", "https://s/a.html", "https://s/a.png", "https://s.org", "https://s/go1.16")] == [True, True, False, False, False]
    path = lambda u: one(spark, webgraph.mirror_path(F.lit(u), F.lit("https://s.org"), "/m"))
    assert path("https://s.org/doc/#go") == "file:////m/doc/index.html#go" and path("https://s.org") == "file:////m/index.html"


def test_reachable_with_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 1)], "src long, dst long")
    got = {r["node"]: r["depth"] for r in webgraph.reachable(edges, spark.createDataFrame([(1,)], "node long")).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 3}


# numbers, text, matrices


def test_scalars(spark):
    assert [one(spark, scalars.wrap(F.lit(x), 8)) for x in (256, -1)] == [0, 255]
    assert [round(one(spark, scalars.cone_volume(F.lit(r), F.lit(h))), 2) for r, h in ((0.0, 0.0), (1.0, 2.0), (5.5, 5.5), (1.234, 5.678))] == [0.0, 2.09, 174.23, 9.05]
    assert [one(spark, scalars.sum_to_n(F.lit(n))) for n in (0, 1, 5, 10, 23)] == [0, 1, 15, 55, 276 & 255]
    assert one(spark, scalars.negate(F.lit(1), 8)) == 255
    assert [one(spark, scalars.pangram(F.lit(t))) for t in ("The quick brown fox jumps over the lazy dog", "abc", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZ@[~é")] == [True, False, False, True]
    values = [20.5, 0.0, -1.25, None, float("nan")]
    got = [r["b"] for r in spark.createDataFrame([(v,) for v in values], "x double").select(scalars.float_bits(F.col("x")).alias("b")).collect()]
    assert got[3] is None and got[:3] == [struct.unpack("<q", struct.pack("<d", v))[0] for v in values[:3]] and got[4] is not None
    assert [one(spark, scalars.fibonacci(F.lit(n))) for n in (0, 1, 2, 10, 90)] == [0, 1, 1, 55, 2880067194370816120]
    assert scalars.least_value(8) == -128 and one(spark, scalars.checked_add(F.lit(2**31 - 1), F.lit(1))) is None
    assert one(spark, scalars.area(F.lit("rect"), F.lit(3.0), F.lit(4.0))) == 12 and round(one(spark, scalars.perimeter(F.lit("circle"), F.lit(5.0), F.lit(0.0))), 6) == round(10 * np.pi, 6)


@pytest.mark.parametrize("text", ["a\tb", "\t", "12345678\tx", "a\n\tb\tc\nd", "plain", "", "tail\t"])
def test_detab_and_entab(spark, text):
    df = spark.createDataFrame([(text,), (None,)], "t string")
    got = [r[0] for r in df.select(scalars.detab(F.col("t"))).collect()]
    assert got == ["\n".join(x.expandtabs(8) for x in text.split("\n")), None]
    back = [r[0] for r in df.select(scalars.entab(scalars.detab(F.col("t")))).collect()]
    assert "\n".join(x.expandtabs(8) for x in back[0].split("\n")) == got[0] and back[1] is None


def test_matrices(spark):
    m = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [4.0, 5.0, 6.0]), (2, [7.0, 8.0, 9.0])], "r long, v array<double>")
    cells = linalg.cells(m, "r", "v")
    assert {(r["i"], r["j"]): r["v"] for r in linalg.transpose(cells).collect()}[2, 1] == 6.0
    narrow = cells.filter("j < 2")
    got = {(r["i"], r["j"]): r["v"] for r in linalg.matmul(linalg.transpose(narrow), cells).collect()}
    a = np.arange(1.0, 10).reshape(3, 3)
    assert got == {(i, j): (a[:, :2].T @ a)[i, j] for i in range(2) for j in range(3)}
    assert linalg.equal(cells, cells).first()["equal"] and not linalg.equal(cells, narrow).first()["equal"]
    flat = F.array(*[F.lit(x) for x in range(1, 7)])
    assert one(spark, linalg.element(flat, 3, F.lit(1), F.lit(2))) == 6


# machines


def register_model(lines, x, y):
    """A straight program of the register machine, a line at a time; "skip" leaves out the next lines if a register is zero."""
    cells, reg, at = {1: x, 2: y}, [0, 0, 0], 0
    while at < len(lines):
        name, *args = lines[at]
        at += 1
        if name == "load":
            reg[args[0]] = cells.get(args[1], 0)
        elif name == "store":
            cells[args[1]] = reg[args[0]]
        elif name in ("add", "sub"):
            reg[args[0]] = (reg[args[0]] + (reg[args[1]] if name == "add" else -reg[args[1]])) % 256
        elif name in ("addi", "subi"):
            reg[args[0]] = (reg[args[0]] + (args[1] if name == "addi" else -args[1])) % 256
        elif name == "skip" and reg[args[0]] == 0:
            at += args[1]
    return cells.get(0, 0)


def random_register_program(rng):
    lines = []
    for _ in range(rng.randrange(3, 25)):
        r, q = rng.choice((1, 2)), rng.choice((1, 2))
        lines.append(rng.choice([("load", r, rng.randrange(0, 7)), ("store", r, rng.randrange(3, 7)), ("add", r, q), ("sub", r, q), ("addi", r, rng.randrange(256)), ("subi", r, rng.randrange(256)), ("skip", r, rng.randrange(3))]))
    return [*lines, ("addi", 1, 0), ("addi", 1, 0), ("store", rng.choice((1, 2)), 0)]


def register_text(lines):
    """Straight instructions have three bytes each, so a branch over n of them is n times three."""
    out = []
    for name, *args in lines:
        if name == "skip":
            out.append(f"beqz r{args[0]} {3 * args[1]}")
        elif name in ("add", "sub"):
            out.append(f"{name} r{args[0]} r{args[1]}")
        else:
            out.append(f"{name} r{args[0]} {args[1]}")
    return "\n".join([*out, "halt"])


def run(program, ops, machine, inputs):
    memory = machines.memory_of(machines.assemble(program, ops), [np.array([x[k] for x in inputs]) for k in range(2)])
    return machine(memory).tolist()


def test_register_programs_against_a_model():
    rng = random.Random(3)
    for _ in range(150):
        lines, inputs = random_register_program(rng), [(rng.randrange(256), rng.randrange(256)) for _ in range(6)] + [(0, 0)]
        assert run(register_text(lines), machines.REGISTER_OPS, machines.run_register, inputs) == [register_model(lines, *x) for x in inputs]


def test_register_loop_counts_up():
    from heddle.plans.catalogue import REGISTER_SUM

    inputs = [(n, 9) for n in (0, 1, 2, 7, 50, 255)]
    assert run(REGISTER_SUM, machines.REGISTER_OPS, machines.run_register, inputs) == [n * (n + 1) // 2 % 256 for n, _ in inputs]


def test_stack_programs_against_a_model():
    rng = random.Random(4)
    for _ in range(150):
        lines, depth = [], 0
        for _ in range(rng.randrange(2, 25)):
            name = rng.choice(["push", "pushi"] + ["store", "pop"] * (depth > 0) + ["add", "sub"] * (depth > 1))
            lines.append((name, rng.randrange(1, 7)) if name in ("push", "store") else (name, rng.randrange(256)) if name == "pushi" else (name,))
            depth += {"push": 1, "pushi": 1, "store": -1, "pop": -1, "add": -1, "sub": -1}[name]
        lines += [("pushi", 5), ("store", 0)] if not depth else [("store", 0)]
        inputs = [(rng.randrange(256), rng.randrange(256)) for _ in range(5)]
        want = []
        for x, y in inputs:
            cells, stack = {1: x, 2: y}, []
            for name, *args in lines:
                if name == "push":
                    stack.append(cells.get(args[0], 0))
                elif name == "pushi":
                    stack.append(args[0])
                elif name == "store":
                    cells[args[0]] = stack.pop()
                elif name == "pop":
                    stack.pop()
                else:
                    top, under = stack.pop(), stack.pop()
                    stack.append((under + top if name == "add" else top - under) % 256)
            want.append(cells.get(0, 0))
        text = "\n".join(" ".join(map(str, x)) for x in [*lines, ("halt",)])
        assert run(text, machines.STACK_OPS, machines.run_stack, inputs) == want


def test_machine_errors():
    with pytest.raises(machines.MachineError):
        run("pop\nhalt", machines.STACK_OPS, machines.run_stack, [(0, 0)])
    with pytest.raises(machines.MachineError):
        machines.assemble("nonsense 1", machines.STACK_OPS)
    with pytest.raises(machines.MachineError):
        machines.run_word(np.full((1, 258), 6, dtype=np.int64))
    with pytest.raises(machines.MachineError):
        run("jump 8", machines.REGISTER_OPS, machines.run_register, [(0, 0)])


def test_word_programs_against_a_model():
    rng = random.Random(5)
    for _ in range(100):
        code, steps = [], []
        for _ in range(rng.randrange(2, 20)):
            kind, r, q, at, n = rng.choice(["load", "store", "add", "addi", "sub"]), rng.choice((1, 2)), rng.choice((1, 2)), rng.randrange(90, 110, 2), rng.randrange(256)
            steps.append((kind, r, q, at, n))
            code += {"load": [machines.WORD_LOAD, r, at], "store": [machines.WORD_STORE, r, at], "add": [machines.WORD_ADD, r, q], "addi": [machines.WORD_ADD | 16, r, n], "sub": [machines.WORD_SUB, r, q]}[kind]
        memory = np.zeros((3, 258), dtype=np.int64)
        memory[:, : len(code) + 1] = [*code, machines.WORD_HALT]
        memory[:, 90:112] = [[rng.randrange(256) for _ in range(22)] for _ in range(3)]
        want = memory[:, 90:112].copy()
        for row in want:
            reg = [0, 0, 0]
            for kind, r, q, at, n in steps:
                if kind == "load":
                    reg[r] = int(row[at - 90]) + 256 * int(row[at - 89])
                elif kind == "store":
                    row[at - 90], row[at - 89] = reg[r] % 256, reg[r] // 256
                else:
                    reg[r] = (reg[r] + (reg[q] if kind == "add" else n if kind == "addi" else -reg[q])) % 65536
        assert (machines.run_word(memory)[:, 90:112] == want).all()


def test_machine_columns_keep_nulls(spark):
    answer = machines.machine_column(machines.assemble("load r1 1\nstore r1 0\nhalt", machines.REGISTER_OPS), machines.run_register)
    df = spark.createDataFrame([(5, 1), (None, 1), (6, None)], "x long, y long")
    assert [r[0] for r in df.select(answer(F.col("x"), F.col("y"))).collect()] == [5, None, None]


# nulls, clashing names, links and sources


@pytest.mark.parametrize("width", [None, 10])
@pytest.mark.parametrize("backward", [True, False])
def test_asof_keeps_null_probes_and_any_column_name(spark, width, backward):
    probes = spark.createDataFrame([(1, 15, 7), (2, None, 8)], "id long, at_ long, cell_ long")
    keys = spark.createDataFrame([(10,), (20,), (None,)], "k long")
    out = keyed.asof(probes, keys, "at_", "k", backward, None if width is None else lambda c: F.floor(c / width))
    assert out.columns == ["id", "at_", "cell_", "match"]
    assert {r["id"]: (r["cell_"], r["match"]) for r in out.collect()} == {1: (7, 10 if backward else 20), 2: (8, None)}


def test_shuffled_with_its_own_column_names(spark):
    df = spark.range(50).select("id", F.lit(1).alias("h_"), F.lit(2).alias("at_"))
    got = relational.shuffled(df, "id", "s", "place").collect()
    assert sorted(r["place"] for r in got) == list(range(1, 51)) and {(r["h_"], r["at_"]) for r in got} == {(1, 2)}


def test_delete_reports_what_was_there(spark):
    table = spark.createDataFrame([("a", 1), ("c", 2)], "k string, there int")
    gone = spark.createDataFrame([("a",), ("b",), ("a",)], "k string")
    assert {r["k"]: r["existed"] for r in keyed.delete_flags(table, gone, "k").collect()} == {"a": True, "b": False}


@pytest.mark.parametrize(
    "link, want",
    [
        ("https://s.org/x", "https://s.org/x"),
        ("/doc/#a", "file:////m/doc/index.html#a"),
        ("http://S.org/doc", "file:////m/doc/index.html"),
        ("//s.organic/x", "https://s.organic/x"),
        ("http://other.org/x", "https://other.org/x"),
        ("/pic.png", "http://s.org/pic.png"),
        ("/doc#a#b", None),
    ],
)
def test_links_of_a_mirror(spark, link, want):
    assert one(spark, webgraph.rewritten(F.lit(link), F.lit("http://s.org/page"), "/m")) == want


def test_reachable_over_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(webgraph, "COMPACT", 3)
    edges = spark.createDataFrame([(i, i + 1) for i in range(8)] + [(3, 0)], "src long, dst long")
    got = {r["node"]: r["depth"] for r in webgraph.reachable(edges, spark.createDataFrame([(1,)], "node long")).collect()}
    assert got == {i: i - 1 for i in range(1, 9)} | {0: 3}


def test_text_sources(spark, tmp_path):
    (tmp_path / "w.txt").write_text("b\na\n\nc\n")
    path = str(tmp_path / "w.txt")
    assert [r["w"] for r in text.lines(spark, path, 0, "w").collect()] == ["b", "a", "", "c"]
    assert [r["value"] for r in text.lines(spark, path, 2).collect()] == ["b", "a"] and text.first_line(spark, path).first()["value"] == "b"
    assert text.exists(spark, path) and not text.exists(spark, f"{path}.not")


def test_bloom_filter_is_written_and_used(spark, tmp_path):
    """Row groups whose value ranges hold a missing key are left out by their Bloom filter alone."""
    df = spark.createDataFrame([(f"k{i:05d}",) for i in range(0, 20000, 2)], "k string")
    sortedtable.write_sorted(df, "k", str(tmp_path / "t"), 2)
    files = [f.read_bytes() for f in (tmp_path / "t").glob("*.parquet")]
    plain = tmp_path / "plain"
    df.repartitionByRange(2, "k").sortWithinPartitions("k").write.parquet(str(plain))
    assert sum(map(len, files)) > sum(len(f.read_bytes()) for f in plain.glob("*.parquet")) + 100_000  # the filters are there
    read = spark.read.parquet(str(tmp_path / "t")).filter("k = 'k00777'")
    assert read.collect() == []
    scan = read._jdf.queryExecution().executedPlan()
    assert "EqualTo(k,k00777)" in scan.toString()


def test_dir_entries(spark, tmp_path):
    from heddle.plans import catalogue

    for k in range(3):
        (tmp_path / f"f{k}").write_text("x")
    assert catalogue.QUERIES["dir_entry_count"](spark, str(tmp_path)).first()["entries"] == 3


def test_asof_result_type_is_kept(spark):
    frame = spark.createDataFrame(pd.DataFrame({"id": [1], "at": [5]}))
    assert dict(keyed.asof(frame, spark.range(3), "at", "id", True).dtypes)["match"] == "bigint"

"""Functions and ordered operators against small simulations."""

import random
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from textloom.errors import ExtractionError
from textloom.functions import text as T
from textloom.operators import records as R
from textloom.operators import sequence as S


def test_white_space_is_the_unicode_set(spark):
    points = [i for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000 and i]
    df = spark.createDataFrame([(i, chr(i)) for i in points if i < 0x3100 or chr(i).isspace()], "i int, c string")
    got = {r[0] for r in df.where(T.blank(F.col("c"))).select("i").collect()}
    assert got == {i for i in points if chr(i).isspace()} and len(got) == 29


def test_normalise(spark):
    raw = ["  a \tb ", "é x", "", None, "\u001cz\u0085", "ﬁ"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, t string")
    for form in ("NFC", "NFD", "NFKC", "none"):
        got = [r[0] for r in df.orderBy("i").select(T.normalise(F.col("t"), form=form)).collect()]
        want = [None if x is None else " ".join(x.split()) for x in raw]
        assert got == [x if x is None or form == "none" else unicodedata.normalize(form, x) for x in want]


def test_roman_and_captures(spark):
    def roman(n):
        out = ""
        for v, s in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
            out, n = out + s * (n // v), n % v
        return out

    df = spark.createDataFrame([(n, roman(n)) for n in range(1, 4000, 7)] + [(None, x) for x in ("", "IIII", "VX", "A", "IC")], "n int, r string")
    assert not df.where(~T.roman_value(F.lower("r")).eqNullSafe(F.col("n"))).count()
    one = spark.createDataFrame([("0012",), ("x",), ("0",)], "c string")
    assert [r[0] for r in one.select(T.convert_capture(F.col("c"), "decimal", width=3)).collect()] == ["012", None, None]
    assert [r[0] for r in one.select(T.convert_capture(F.col("c"), "decimal", offset=1)).collect()] == ["13", None, "1"]
    with pytest.raises(ExtractionError):
        T.convert_capture(F.col("c"), "string", width=2)


def test_globs_patterns_templates(spark):
    df = spark.createDataFrame([("Text/A[1].xhtml#1.2",)], "p string")
    ok = lambda g: df.select(T.glob_any(F.col("p"), [g])).head()[0]
    assert ok("text/*#1.?") and ok("*[0-9]].xhtml#*") and ok(T.literal_glob("Text/A[1].xhtml#1.2")) and not ok("text/[!a]*") and not ok("*.xhtml")
    s = spark.createDataFrame([("É\u001cz x",)], "t string")
    assert s.where(T.searches(F.col("t"), r"^é\s(?P<a>z).$", True)).count() == 0
    assert s.where(T.searches(F.col("t"), r"^é\s(?P<a>z).x\Z", True)).count() == 1
    row = s.select(T.render("{group}-{number:04d}.{number:>3}{{", {"group": F.lit("g"), "number": F.lit(12)})).head()[0]
    assert row == "g-0012. 12{"
    for bad in ("{x}", "{number!r}", "{number:{group}}", "{", "{number:zz}"):
        with pytest.raises(ExtractionError):
            s.select(T.render(bad, {"group": F.lit("g"), "number": F.lit(1)})).collect()


def test_numbering_like_a_loop(spark):
    rng = random.Random(3)
    rows = [(b, i, rng.choice("xy"), rng.choice(["block", "line-start", "line", "line", "fixed"]), rng.random() < 0.3) for b in range(30) for i in range(20)]
    df = spark.createDataFrame(rows, "b int, i int, g string, role string, ins boolean")
    got = {(r["b"], r["i"]): (r["block_no"], r["line_no"], r["line_ok"]) for r in S.number(df, ["b", "g"], ["i"], insertion="ins").collect()}
    for b in range(30):
        state = {g: [0, None] for g in "xy"}
        for _, i, g, role, ins in (r for r in rows if r[0] == b):
            s, line, ok = state[g], None, True
            if role == "block":
                s[0], s[1] = s[0] + 1, None
            elif role == "line-start":
                s[0], s[1], line = s[0] + 1, 1, 1
            elif role == "line":
                ok = s[1] is not None
                if ok:
                    s[1] += 1
                    line = s[1]
            elif not ins:
                s[1] = None
            assert got[b, i] == (s[0], line, ok)


def test_runs_like_a_loop(spark):
    rng = random.Random(4)
    rows = []
    for b in range(40):
        for i in range(25):
            rule = rng.choice([-1, -1, 0, 1])
            rows.append((f"d{b}", i, rng.randint(1, 3) if rule < 0 else 0, rule, [rng.random() < 0.6, rng.random() < 0.8], rng.random() < 0.1, rng.random() < 0.1))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "b string, i long, takes int, rule int, goes_on array<boolean>, breaks boolean, ends_after boolean").repartition(3)
    got = {(r["b"], r["i"]): (r["run"], r["place"]) for r in S.runs(df, "b", "i").collect()}
    assert len(got) == len(rows)
    for b in range(40):
        own = sorted(r for r in rows if r[0] == f"d{b}")
        i = 0
        while i < 25:
            j = i + 1
            if own[i][3] < 0:
                j = min(25, i + own[i][2])
            else:
                while j < 25 and own[j][4][own[i][3]] and not own[j][5] and not own[j - 1][6]:
                    j += 1
            for k in range(i, j):
                assert got[f"d{b}", k] == (i, k - i + 1)
            i = j


def test_list_ordinals_and_attachment(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, None, 0, None, -2, None])], "l int, i int, v int")
    f = lambda d, s, r: [x[0] for x in S.list_ordinals(d, ["l"], ["i"], "v", F.lit(s).cast("int"), F.lit(r)).orderBy("i").select("ordinal").collect()]
    assert f(df, 5, False) == [5, 6, 0, 1, -2, -1]
    assert f(df.withColumn("v", F.lit(None).cast("int")), None, True) == [6, 5, 4, 3, 2, 1]
    e = spark.createDataFrame([(1, k, f"e{k}") for k in (0, 5, 9)] + [(2, 1, "x")], "d int, k int, event string")
    a = spark.createDataFrame([(1, k, f"a{k}") for k in (3, 5)], "d int, k int, anchor string")
    assert sorted(tuple(r) for r in S.attach_next(e, a, "d", "k", "event", "anchor").collect()) == [(1, "e0", "a3", False), (1, "e5", "a5", False), (1, "e9", "a5", True), (2, "x", None, True)]


def test_errata_and_escapes(spark):
    df = spark.createDataFrame([("a", "aaa b"), ("b", "x+y"), ("c", None)], "id string, text string")
    errata = spark.createDataFrame([("a", 1, "aa", "z"), ("b", 1, "+", "$1\\"), ("b", 2, "$1\\y", "q")], "id string, ord int, find string, replacement string")
    got = {r["id"]: (r["text"], r["errata_ok"]) for r in R.apply_errata(df, errata, "id").collect()}
    assert got == {"a": ("aaa b", False), "b": ("xq", True), "c": (None, True)}
    s = spark.createDataFrame([('<a&"\r\t[x]\\',)], "t string")
    assert s.select(R.escape_xml(F.col("t"), attribute=True)).head()[0] == "&lt;a&amp;&quot;&#13;&#9;[x]\\"
    assert s.select(R.escape_delimiters(F.col("t"), ["[", "]"], whitespace=True)).head()[0] == '<a&"\\r\\t\\[x\\]\\\\'


def test_runs_of_a_single_while_rule_need_no_python(spark):
    import random

    from pyspark.sql import functions as F

    from textloom.operators import sequence as S

    draw = random.Random(5)
    rows = [(b, 3 * i, *(draw.random() < p for p in (0.4, 0.7, 0.15, 0.15))) for b in range(40) for i in range(draw.randint(1, 30))]
    df = spark.createDataFrame(rows, "b int, i long, starts boolean, goes boolean, breaks boolean, ends_after boolean")
    keys = df.select("b", "i", F.when(F.col("starts"), 0).otherwise(1).alias("takes"), F.when(F.col("starts"), 0).otherwise(-1).alias("rule"), F.array("goes").alias("goes_on"), "breaks", "ends_after")
    want = sorted(map(tuple, S.runs(keys, "b", "i").select("b", "i", "run", "place").collect()))
    found = S.runs_while(df, "b", "i", F.col("starts"), F.col("goes")).select("b", "i", "run", "place")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == want and max(p for *_, p in want) > 3
    assert plan.count("Exchange hashpartitioning") == 1 and "MapInArrow" not in plan


import pytest
from pyspark.sql import functions as F

from inkstone.functions import color, values
from inkstone.sources.files import glob_regex

# Published pairs: Sharma, Wu and Dalal 2005.
PAIRS = [
    ((50.0, 2.6772, -79.7751), (50.0, 0.0, -82.7485), 2.0425),
    ((50.0, 3.1571, -77.2803), (50.0, 0.0, -82.7485), 2.8615),
    ((50.0, -1.3802, -84.2814), (50.0, 0.0, -82.7485), 1.0),
    ((50.0, 0.0, 0.0), (50.0, -1.0, 2.0), 2.3669),
    ((50.0, 2.49, -0.001), (50.0, -2.49, 0.0009), 7.1792),
    ((50.0, 2.5, 0.0), (73.0, 25.0, -18.0), 27.1492),
    ((60.2574, -34.0099, 36.2677), (60.4626, -34.1751, 39.4387), 1.2644),
    ((2.0776, 0.0795, -1.135), (0.9033, -0.0636, -0.5514), 0.9082),
]


def test_color_distance_equals_published_pairs(spark):
    df = spark.createDataFrame([(*p, *q, d) for p, q, d in PAIRS], "p_l double, p_a double, p_b double, q_l double, q_a double, q_b double, d double")
    for r in color.with_delta_e(df, "p", "q", "got").collect():
        assert abs(r.got - r.d) < 1e-4
    for p, q, d in PAIRS:
        assert abs(color.delta_e(p, q) - d) < 1e-4


def test_color_normal_forms_and_contrast(spark):
    cases = {
        "#ABC": "#aabbcc", "#abcd": "#aabbcc", "#11223344": "#112233", "rgb(255, 0,10)": "#ff000a", "rgba(100%, 0%, 0%, .5)": "#ff0000", "hsl(120, 100%, 50%)": "#00ff00",
        "hsl(210 50% 40%)": "#336699", "hsl(300, 100%, 25%)": "#800080", "hsla(60, 100%, 50%, 1)": "#ffff00", "hsl(0, 0%, 50%)": "#808080", "RebeccaPurple": "#663399", "#12345": None, "var(--x)": None, "nope": None, "rgb(1,2)": None,
    }
    df = spark.createDataFrame(list(cases.items()), "v string, want string")
    for r in df.withColumn("got", color.normalise(F.col("v"))).collect():
        assert r.got == r.want, r.v
    assert len(color.named_colors()) == 148
    ratio = spark.createDataFrame([("#ffffff", "#000000"), ("#767676", "#ffffff"), ("#aaaaaa", "#ffffff")], "a string, b string").select(color.contrast(F.col("a"), F.col("b")).alias("r")).collect()
    assert [round(r.r, 2) for r in ratio] == [21.0, 4.54, 2.32]


def test_values(spark):
    rows = [("13px", "padding"), ("1.5rem", "margin"), ("50%", "gap"), ("2em", "top"), ("var(--x)", "left"), ("$gap", "padding"), ("#fff", "color"), ("Inter", "font-family"), ("red", "color"), ("1px solid #f00", "border")]
    got = [r.p for r in spark.createDataFrame(rows, "v string, p string").select(values.parse_value(F.col("v"), F.col("p")).alias("p")).collect()]
    assert [(p.kind, p.value, p.unit, p.is_token) for p in got] == [
        ("spacing", 13.0, "px", False), ("spacing", 24.0, "px", False), ("spacing", 50.0, "%", False), ("unknown", None, None, False), ("spacing", None, None, True),
        ("spacing", None, None, True), ("color", None, None, False), ("fontFamily", None, None, False), ("unknown", None, None, False), ("color", None, None, False),
    ]
    near = spark.createDataFrame([(18.0,), (13.0,), (100.0,), (None,)], "n double").select(values.nearest(F.col("n"), [16, 20, 12], 4).alias("x")).collect()
    assert [r.x for r in near] == [16.0, 12.0, None, None]
    text = spark.createDataFrame([(13.0,), (1.5,)], "n double").select(values.number_text(F.col("n")).alias("x")).collect()
    assert [r.x for r in text] == ["13", "1.5"]


def test_class_values(spark):
    cases = {
        "mt-[13px]": ("mt", "13px", "spacing"), "md:hover:-px-[2rem]": ("px", "2rem", "spacing"), "bg-[#ff5733]": ("bg", "#ff5733", "color"), "rounded-[7px]": ("rounded", "7px", "radius"), "rounded-t-[7px]": ("rounded-t", "7px", "radius"),
        "text-[15px]": ("text", "15px", "fontSize"), "!w-[50%]": ("w", "50%", "spacing"), "[padding:3px]": ("padding", "3px", "spacing"), "[&:hover]:mt-[13px]": ("mt", "13px", "spacing"), "w-[calc(1px+2px)]": None, "flex": None, "grid-cols-[1fr_2fr]": ("grid-cols", "1fr_2fr", "other"),
        "[&:is([a=b],[c=[d:e]])]:md:p-[3px]": ("p", "3px", "spacing"), "w-[x[y[z]]]": ("w", "x[y[z]]", "spacing"), "gap-[1px]/50": ("gap", "1px", "spacing"), "a:[color:#fff]!": ("color", "#fff", "color"), "m-[]": None, "m-[3px": None, "[nothing]": None, "-m-[ ]": None, "w-[CALC(1px)]": None, "m]-[3px]": ("m]", "3px", "other"),
    }
    for r in spark.createDataFrame([(k,) for k in cases], "n string").withColumn("c", values.arbitrary_class(F.col("n"))).collect():
        want = cases[r.n]
        assert (r.c is None) if want is None else (r.c.utility, r.c.raw, r.c.category) == want, r.n
    fixed = spark.createDataFrame([("[&:hover]:mt-[13px]",), ("[padding:3px]!",)], "n string").select(F.concat(values.arbitrary_class(F.col("n"))["head"], F.lit("12px"), values.arbitrary_class(F.col("n"))["tail"]).alias("x")).collect()
    assert [r.x for r in fixed] == ["[&:hover]:mt-[12px]", "[padding:12px]!"]


def test_similarity(spark):
    rows = [("CardPrimary", "CardOld", 1.0), ("Primary", "Main", None), ("Abc", "Abd", 2 / 3), ("A", "A", 1.0)]
    for r in spark.createDataFrame(rows, "a string, b string, want double").withColumn("s", values.name_similarity(F.col("a"), F.col("b"))).collect():
        assert r.want is None or abs(r.s - r.want) < 1e-9
    sets = spark.createDataFrame([([], [], 1.0), (["a"], [], 0.0), (["a", "b", "b"], ["b", "c"], 1 / 3)], "a array<string>, b array<string>, want double")
    assert all(abs(r.s - r.want) < 1e-9 for r in sets.withColumn("s", values.jaccard(F.col("a"), F.col("b"))).collect())


@pytest.mark.parametrize(("glob", "yes", "no"), [("**/node_modules/**", "a/node_modules/x.css", "a/x.css"), ("**/*.min.css", "x.min.css", "x.css"), ("src/*.{css,scss}", "src/a.scss", "src/b/a.css")])
def test_globs(glob, yes, no):
    import re

    assert re.match(glob_regex(glob), yes) and not re.match(glob_regex(glob), no)

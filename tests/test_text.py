import pytest
from pyspark.sql import functions as F

from siftwood.functions import text
from siftwood.operators.projections import preprocess, strip_markdown


def apply(spark, values, fn):
    rows = spark.createDataFrame(list(enumerate(values)), "id int, t string")
    return [r["out"] for r in rows.select("id", fn(F.col("t")).alias("out")).orderBy("id").collect()]


MARKDOWN = [
    ("# Title\n\nSome *soft* and **hard** words", "Title\nSome soft and hard words"),
    ("## Closed ##", "Closed"),
    ("Under\n=====\ntext", "Under\n\ntext".replace("\n\n", "\n")),
    ("see [the docs](https://x.example/a_b_c) now", "see the docs now"),
    ("a ![picture](p.png) b", "a  b"),
    ("- one\n- two\n1. three", "one\ntwo\nthree"),
    ("> quoted\n> > deeper", "quoted\ndeeper"),
    ("| a | b |\n|---|:-:|\n| 1 | 2 |", "a b\n1 2"),
    ("use `a*b*c` here", "use a*b*c here"),
    ("```python\n# kept *as is*\n```\nafter", "# kept *as is*\nafter"),
    ("1 &lt; 2 &amp;amp; 3", "1 < 2 &amp; 3"),
    ("<b>bold</b> <br/> x", "bold  x"),
    ("snake_case_name and _soft_", "snake_case_name and soft"),
    ("5 * 3 * 2", "5 * 3 * 2"),
    ("***", ""),
    ("", ""),
    (None, None),
]


@pytest.mark.parametrize("source, plain", MARKDOWN)
def test_markdown(spark, source, plain):
    assert apply(spark, [source], text.markdown_text) == [plain]


def test_strip_markdown_keeps_raw_on_request(spark):
    df = spark.createDataFrame([("*x*", "*y*")], "body string, title string")
    kept = strip_markdown(df, ["body"]).first()
    assert (kept["body"], kept["body_raw"], kept["title"]) == ("x", "*x*", "*y*")
    assert strip_markdown(df, ["body"], keep_raw=False).columns == ["body", "title"]


def test_html(spark):
    page = (
        "<html><head><title>T &amp; U</title><style>p{}</style><script>if (a<b) {}</script></head>"
        "<body><!-- no --><p>one <b>bo</b>ld</p><p>two&nbsp;three</p></body></html>"
    )
    assert apply(spark, [page, None], text.html_text) == ["T & U one bold two three", None]


def test_tokenize(spark):
    got = apply(spark, ["The quick-brown FOX, n°1!", "  ", "Été", None], text.tokenize)
    assert got == [["the", "quick", "brown", "fox", "n", "1"], [], ["été"], None]


def test_cjk_bigrams(spark):
    values = ["日本語", "猫", "漢字カナabc12", "abc猫def", "東京 タワー", "データ。文", "plain text"]
    assert apply(spark, values, text.cjk_bigrams) == [
        ["日本", "本語"],
        ["猫"],
        ["漢字", "字カ", "カナ", "abc12"],
        ["abc", "猫", "def"],
        ["東京", "タワ", "ワー"],
        ["デー", "ータ", "文"],
        ["plain", "text"],
    ]


def test_normalize_terms(spark):
    values = ["Ａｂｃ１２ Élan naïve"]
    normal = lambda c: text.normalize_terms(F.split(c, " "))
    assert apply(spark, values, normal) == [["abc12", "elan", "naive"]]


def test_stop_filter_by_language(spark):
    df = spark.createDataFrame([("the die des x", "en"), ("the die des x", "de"), ("the die des x", "xx"), ("the x", None)], "t string, l string")
    by_row = df.select(text.stop_filter(text.tokenize(F.col("t")), F.col("l")).alias("o")).collect()
    assert [r["o"] for r in by_row] == [["die", "des", "x"], ["the", "x"], ["the", "die", "des", "x"], ["the", "x"]]
    every = df.select(text.stop_filter(text.tokenize(F.col("t"))).alias("o")).collect()
    assert [r["o"] for r in every] == [["x"]] * 4


def test_analyze_order(spark):
    # Base form first, then stop words, then folding: "été" is no stop word,
    # and "etant" becomes "est", which is one.
    lemmas = F.create_map(F.lit("étant"), F.lit("est"))
    fn = lambda c: text.analyze(c, lemmas=lemmas)
    assert apply(spark, ["Étant été ＡＢ 日本語"], fn) == [["ete", "ab", "日本", "本語"]]


def test_preprocess_applies_steps_in_order(spark):
    df = spark.createDataFrame([("a",)], "t string")
    steps = [lambda d: d.withColumn("t", F.concat("t", F.lit("b"))), lambda d: d.withColumn("t", F.upper("t"))]
    assert preprocess(df, steps).first()["t"] == "AB"
    assert preprocess(df, []).first()["t"] == "a"


def test_doc_text_skips_nulls(spark):
    df = spark.createDataFrame([("t", None, "b")], "a string, b string, c string")
    assert df.select(text.doc_text(F.col("a"), F.col("b"), F.col("c")).alias("x")).first()["x"] == "t b"


@pytest.mark.parametrize(
    "markup, plain",
    [
        ("caf&eacute; &#8217;s &mdash; &hellip; &#x27;x&#X27; &copy;", "caf\u00e9 \u2019s \u2014 \u2026 'x' \u00a9"),
        ("&amp;lt; &nosuch; &#0; &#xD800; &#x110000; &#99999999999; &#x1F600;", "&lt; &nosuch; &#0; &#xD800; &#x110000; &#99999999999; \U0001f600"),
        ("a&nbsp;b&#160;c &Eacute;&eacute; &middot; & &; &#; &#x;", "a b c \u00c9\u00e9 \u00b7 & &; &#; &#x;"),
        ("no entity", "no entity"),
    ],
)
def test_entities(spark, markup, plain):
    df = spark.createDataFrame([(markup,)], "t string")
    assert df.select(text.html_text(F.col("t"))).first()[0] == plain


LONG = {run: 100_000 for run in ["\n", "*", "- ", "> "]} | {run: 4_000 for run in ["\n \t", "_ ", ">", "|-", "#", "`", "[", "<", "&"]}


@pytest.mark.parametrize("run, times", LONG.items())
def test_long_runs_of_markup_pass(spark, run, times):
    df = spark.createDataFrame([("a\n" + run * times + "\nb",)], "t string")
    out = df.select(text.markdown_text(F.col("t")), text.html_text(F.col("t"))).first()
    assert out[0].startswith("a") and out[1].startswith("a")

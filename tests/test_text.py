from pyspark.sql import functions as F

from driftglass.functions import text


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_strip_html(spark):
    assert one(spark, text.strip_html, "<script>a</script>x<b>y</b>") == "x y "
    assert one(spark, text.strip_html, "a<STYLE t='1'>\nq</style>\n\n b") == "a b"


def test_strip_references(spark):
    cases = {"body \\begin{thebibliography} x": "body ", "early References then much longer body text follows here": None, "a long enough body References [1]": "a long enough body ", "b \\bibitem{a} q \\bibitem{c} z": "b   ", "": ""}
    for given, want in cases.items():
        assert one(spark, text.strip_references, given) == (given if want is None else want)


def test_audit(spark):
    docs = spark.createDataFrame([(1, "Fat tails and excess kurtosis: a stylized fact of an agent-based model. Fat-tail."), (2, None)], "id long, body string")
    got = {r.id: r for r in text.audit(docs, "id", "body").collect()}
    assert got[1].sf_mention and got[1].is_sim and got[1].counts["fat-tails"] == 3 and got[1].ge1 == got[1].ge3 == ["fat-tails"]
    assert not got[2].fetched and got[2].ge1 == [] and text.prevalence(text.audit(docs, "id", "body")).where("share_ge3 = 1").count() == 1
    assert one(spark, text.labels, " B, a ,,C") == ["a", "b", "c"]

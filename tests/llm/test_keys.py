"""Private keys are spans of the whole key, known by their bodies."""

from corvane.llm import secret_scan

HEAD, FOOT = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"


def key(seed, n=12):
    return "\n".join((chr(65 + seed) + "bC9+/dE" * 9) if k == n - 1 else "MIIE" + "aB3/" * 15 for k in range(n))


def test_spans_and_bodies():
    whole = f"{HEAD}\n{key(0)}\n{FOOT}"
    for text, want in [
        (f"see {whole} and so on", whole),
        (f"a\n{HEAD}\n{key(0)}\nThen some prose follows, quite long.", f"{HEAD}\n{key(0)}"),
        (f"x {HEAD}, token=mine1234", HEAD),
        (whole.replace("\n", "\\n"), whole.replace("\n", "\\n")),
        (whole.replace("RSA", "RSA " + "VERY LONG " * 9), whole.replace("RSA", "RSA " + "VERY LONG " * 9)),
    ]:
        (a, b, _, _), = secret_scan.keys(text)
        assert text[a:b] == want
    two = secret_scan.keys(f"{HEAD}\n{key(1)}\n{whole}")
    assert len(two) == 2 and two[0][3] == key(1).replace("\n", "") and two[1][3] == key(0).replace("\n", "")


def test_copies_and_live_keys(spark):
    rows = [(i, f"{HEAD}\n{key(1, 1)}\n{FOOT}\nprose of document {i}", f"s{i}", "en") for i in range(3)]
    rows += [(10 + i, f"{HEAD}\n{key(2 + i)}\n{FOOT} tail", f"s{i}", "en") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    got = secret_scan.secrets(docs)
    text = {r.doc_id: r.text for r in secret_scan.masked(docs, got).collect()}
    assert text[0] == "<EXAMPLE_PEM>\nprose of document 0" and text[11] == "<LIVE_PEM> tail"

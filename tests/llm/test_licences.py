"""Licences against a plain version, and the cases that repetition used to lose."""

from corvane.llm import license_scan
from corvane.llm.license_scan import LEAST, TEMPLATES, bigrams, bounds, fewest_words


def plain(text):
    """(line, licence, common, size) of lines and of the whole text."""
    lines, out = text.split("\n"), set()
    for i, part in [(0, text)] * (len(lines) > 1) + [(i + 1, x) for i, x in enumerate(lines)]:
        g = set(bigrams(part))
        for name, t in TEMPLATES.items():
            t = bigrams(t)
            c = len(g & set(t))
            if g and 2000 * c >= LEAST * (len(g) + len(t)):
                out.add((i, name, c, len(g)))
    return out


def test_a_text_that_holds_a_licence_twice(spark):
    mit = TEMPLATES["MIT-text"]
    texts = [f"{mit}\n{mit}", "\n".join([mit.replace(", ", ",\n")] * 3), "Released under the MIT License. " * 3, "mit " * 500, " ".join(TEMPLATES["ISC"].split()[5:]), "", TEMPLATES["ISC"].replace("and", "or")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {(r.doc_id, r.line, r.licence, r.common, r["size"]) for r in license_scan.matches(docs).collect()}
    assert {x for x in got if x[1] == 0} == {(i, *m) for i, t in enumerate(texts) for m in plain(t) if m[0] == 0}
    assert {(i, *m) for i, t in enumerate(texts) for m in plain(t)} <= got
    best = {r.doc_id: (r.best, r.best_permille) for r in license_scan.licences(docs).collect()}
    assert best[1][0] == "MIT-text" and best[1][1] > 990 and best[2][0] == "MIT"


def test_a_matching_part_has_the_fewest_words():
    for t in TEMPLATES.values():
        w, m = license_scan._split(t), len(bigrams(t))
        for a in range(len(w)):
            for b in range(a + 2, len(w) + 1, 3):
                c = len(set(bigrams(" ".join(w[a:b]))))
                if c >= bounds(m)[0]:
                    assert len(set(w[a:b])) >= fewest_words(bigrams(t), bounds(m)[0])


def test_notices_over_several_lines(spark):
    import textwrap

    wrap = lambda k, n: "\n".join("# " + x for x in textwrap.wrap(TEMPLATES[k], n))
    code = "\n".join(f"def f{i}(x):\n    return the_{i} + x" for i in range(60))
    cut = TEMPLATES["MIT-full"].replace("conditions: ", "conditions:\n\n").replace("Software. THE", "Software.\n\nTHE")
    header = wrap("Apache-2.0-header", 75)
    texts = [f"{code}\n{header}\n{code}", f"MIT License\n\nCopyright (c) 2020 A. Person\n\n{cut}", f"Copyright 2020\n\n{TEMPLATES['BSD-2-Clause-full']}", f"{code}\n{header}\n{code}\n{header}\n{code}", f"{code}\nThis work is licensed under a Creative\nCommons Attribution 4.0 International License.\n{code}", code, f"{code}\nReleased under the MIT License.\nSee the file."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {(r.doc_id, r.line, r["last"], r.licence): 2000 * r.common // (r["size"] + r.template_size) for r in license_scan.matches(docs).collect()}
    n = len(header.split("\n"))
    assert got[0, 121, 120 + n, "Apache-2.0-header"] == 1000
    assert {k for k in got if k[0] == 3 and k[3] == "Apache-2.0-header"} == {(3, 121, 120 + n, "Apache-2.0-header"), (3, 241 + n, 240 + 2 * n, "Apache-2.0-header")}
    assert got[1, 0, 0, "MIT-full"] > 900 and got[2, 0, 0, "BSD-2-Clause-full"] > 900
    assert got[1, 5, 7, "MIT-text"] == 1000 and got[4, 121, 122, "CC-BY-4.0"] == 1000
    assert {k for k in got if k[0] in (5, 6)} == {(6, 121, 121, "MIT")}


def test_words_are_split_once_and_only_where_they_may_match(spark):
    """A part's words were joined from lines again at every word; texts without a template's words met the regular expression."""
    marks = "".join(map(chr, [*range(0x0A), *range(0x0B, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
    words = TEMPLATES["MIT"].split()
    texts = [*(c.join(words) for c in marks), "ä " + TEMPLATES["MIT"].upper(), TEMPLATES["MIT"].replace("MIT", "MİT"), TEMPLATES["MIT"].replace("License", "K License"), None, "", "\x00", "prose"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {(r.doc_id, r.line, r.licence, r.common, r["size"]) for r in license_scan.matches(docs).collect()}
    assert got == {(i, *m) for i, t in enumerate(texts) for m in plain(t or "")} and len(got) > len(marks)
    plan = license_scan.licences(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("flatten(slice(") == 1 and "split(translate(" in plan

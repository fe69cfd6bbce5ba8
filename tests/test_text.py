"""Hand-worked cases of the column expressions."""

import time

import pytest
from pyspark.sql import functions as F

from codexmill.functions import ids, text


def value(spark, column, **inputs):
    row = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} string" for k in inputs)) if inputs else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("raw", "slug"),
    [("  Hello, World! ", "hello-world"), ("---", "node"), ("", "node"), ("日本語", "node"), ("a" * 50, "a" * 40), ("Ünï code 9", "n-code-9")],
)
def test_slug(spark, raw, slug):
    assert value(spark, ids.slug(F.col("t")), t=raw) == slug


def test_ids_are_content_addressed(spark):
    import hashlib

    body = "日本語　テキスト"
    digest = hashlib.sha256(body.encode()).hexdigest()
    assert value(spark, ids.node_id(F.col("b"), F.col("d")), b=body, d="My Doc.md") == f"node:my-doc-md:{digest[:12]}"
    assert value(spark, ids.edge_id(F.col("a"), F.col("b"), F.lit("x")), a="1", b="2") == "edge:" + hashlib.sha256(b"1|2|x").hexdigest()[:16]


def windows(t, size, overlap):
    step, out, start = size - overlap, [], 0
    while start < len(t):
        end = min(start + size, len(t))
        if t[start:end].strip():
            out.append((start, end, t[start:end]))
        if end == len(t):
            break
        start += step
    return out


@pytest.mark.parametrize("t", ["", "abc", "x" * 10, "x" * 11, "ab" * 40, " " * 12 + "z", "日" * 25])
def test_chunks(spark, t):
    assert [tuple(c) for c in value(spark, text.chunks(F.col("t"), 10, 3), t=t)] == windows(t, 10, 3)


def test_jaccard(spark):
    assert value(spark, text.token_jaccard(F.col("a"), F.col("b")), a="Foo/bar x-1 x-1", b="foo/bar y") == pytest.approx(1 / 3)
    assert value(spark, text.token_jaccard(F.col("a"), F.col("b")), a="!!", b="foo") == 0


def test_frontmatter(spark):
    got = value(spark, text.frontmatter(F.col("t")), t="---\ntitle: \"A: b\"\nsummary: s\ntitle: c\n---\n\n body \n")
    assert got["meta"] == {"title": "c", "summary": "s"} and got["body"] == "body"
    plain = value(spark, text.frontmatter(F.col("t")), t=" body \n")
    assert plain["meta"] == {} and plain["body"] == " body \n"


@pytest.mark.parametrize(
    ("raw", "ref"),
    [("- `node:a:1`", "node:a:1"), ("id: node:a:1 (The title)", "node:a:1"), ("node:a:1 | cell", "node:a:1"), ('"node:a:1",', "node:a:1"), ("", "")],
)
def test_clean_node_ref(spark, raw, ref):
    assert value(spark, text.clean_node_ref(F.col("t")), t=raw) == ref


def test_titles(spark):
    assert value(spark, text.title_of(F.col("t")), t="x\n## Head ##x\n# y") == "Head ##x"
    assert value(spark, text.title_of(F.col("t")), t="#\n# y") is None
    assert value(spark, text.humanize(F.col("t")), t="03-foo/bar it's abc-x") == "Foo/Bar It'S Abc X"
    assert value(spark, text.humanize(F.col("t")), t="12-") == "General"
    assert value(spark, text.coarse_key(F.col("t")), t="Chapter 26: on and on") == "Ch 26"
    assert value(spark, text.coarse_key(F.col("t")), t="a" * 23) == "Misc"


def test_ranges_and_lists(spark):
    assert [tuple(r) for r in value(spark, text.parse_ranges(F.col("t")), t='[[1, 2], [3], ["4", "5"], ["x", 1]]')] == [(1, 2), (4, 5)]
    assert value(spark, text.parse_ranges(F.col("t")), t="nonsense") == []
    assert value(spark, text.distinct_ignoring_case(F.split("t", ","), 2), t="A, a,b ,C") == ["A", "b"]
    assert value(spark, text.natural_number(F.col("t")), t="07-x.md") == 7
    assert value(spark, text.natural_number(F.col("t")), t="x.md") == 10**9


def test_images(spark):
    t = "![a](x.png \"t\")\n```\n![no](y.png)\n```\ntext ![b](<z.png>)"
    assert [tuple(i) for i in value(spark, text.images(F.col("t")), t=t)] == [("a", "x.png"), ("no", "y.png"), ("b", "z.png")]
    assert value(spark, text.image_line_numbers(F.col("t")), t=t) == [0, 4]
    unit = "a <image-unit><image-media>M</image-media><image-description>D</image-description></image-unit> b"
    assert value(spark, text.strip_image_media(F.col("t")), t=unit) == "a D b"
    marked = "a \n\n[Embedded image description]\nD\n[/Embedded image description]\n\n b"
    assert value(spark, text.embed_safe(F.col("t")), t=unit) == marked
    bare = "a <image-unit><image-media>M</image-media><image-description> </image-description></image-unit> b <image-media>N</image-media>"
    assert value(spark, text.embed_safe(F.col("t")), t=bare) == "a \n\n[Embedded image omitted: no description available]\n\n b \n\n[Embedded image media omitted]\n\n"
    assert value(spark, text.embed_safe(F.col("t")), t="x data:image/png;base64,AA\nAA==, y") == "x data:image;base64,[omitted], y"


def test_blocks_and_tables(spark):
    assert value(spark, text.mermaid_blocks(F.col("t")), t="```mermaid\na-->b\n```\n```MERMAID \n\n```") == ["a-->b"]
    html = "<table><tr><th>A</th><th>B|C</th></tr><tr><td>1<br>2</td></tr></table>"
    assert value(spark, text.table_markdown(F.col("t")), t=html) == "| A | B\\|C |\n| --- | --- |\n| 1<br>2 |  |"
    assert value(spark, text.table_markdown(F.col("t")), t="none") == ""
    assert value(spark, text.extract_json(F.col("t")), t='so: {"a": {"b": 1}} end') == '{"a": {"b": 1}}'
    assert value(spark, text.sse_frames(F.col("t")), t='data: {"a":1}\n\n: ping\n\ndata: {"b":2}\n\n') == ['{"a":1}', '{"b":2}']
    assert value(spark, text.html_unescape(text.html_escape(F.col("t"))), t="<a & 'b'>") == "<a & 'b'>"


def test_hash_to_unit(spark):
    h = 2166136261
    for c in "node-1":
        h = ((h ^ ord(c)) * 16777619) % 2**32
    assert value(spark, text.fnv1a_unit(F.col("t")), t="node-1") == pytest.approx(h / 2**32)


def test_clean_optional(spark):
    assert value(spark, text.clean_optional(F.col("t"), 6), t=" a　b  cdefg ") == "a b c…"
    assert value(spark, text.clean_optional(F.col("t"), 6), t="　 ") is None
    assert value(spark, text.truncated(F.col("t"), 3), t="abcd") == "abc… (4 chars)"


def test_image_units_do_not_reach_into_each_other(spark):
    unit = lambda x: f"<image-unit id='1'>{x}</image-unit>"
    said, media = "<image-description> d </image-description>", "<image-media>" + "A" * 50_000 + "</image-media>"
    rows = {unit(media + "note") + " KEEP " + unit(media + said): "note KEEP d", unit("plain"): "plain", "a </image-unit> b": "a </image-unit> b", "no unit": "no unit", "": ""}
    df = spark.createDataFrame([(k,) for k in rows], "t string")
    assert {r[0]: r[1] for r in df.select("t", text.strip_image_media(F.col("t"))).collect()} == rows
    safe = spark.createDataFrame([("x data:image/png;base64,AAAA= following words",)], "t string").select(text.embed_safe(F.col("t"))).first()[0]
    assert safe == "x data:image;base64,[omitted] following words"


def test_windows_of_a_long_text_cost_no_square(spark):
    body = "ab é" * 150_000
    rows = spark.createDataFrame([(body,)], "t string").select(F.explode(text.chunks(F.col("t"), 3, 1)).alias("c")).select("c.*")
    began = time.perf_counter()
    got = [tuple(r) for r in rows.collect()]
    assert time.perf_counter() - began < 40
    want = [(i, min(i + 3, len(body)), body[i : i + 3]) for i in range(0, len(body) - 1, 2)]
    assert got == [w for w in want if w[2].strip()]


def test_only_texts_with_accents_are_folded(spark):
    rows = spark.createDataFrame([("Écru, naïve x-1",), ("plain Text 2",), (None,), ("日本 ß",)], "t string").select(text.index_terms(F.col("t")).alias("v"))
    assert [r["v"] for r in rows.collect()] == [["ecru", "naive", "x", "1"], ["plain", "text", "2"], [], ["日本", "ß"]]
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert "CASE WHEN RLIKE" in plan and plan.index("CASE WHEN RLIKE") < plan.index("translate(")

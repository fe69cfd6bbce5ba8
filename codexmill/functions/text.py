"""Text as column expressions: tokens, chunks, markdown, image units, tables, clean-up."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import SPACE, blank, collapse, or_else, strip, text_or

#: Letters that the keyword index folds, and what to. Fixed values.
FOLD_FROM = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ"
FOLD_TO = "aaaaaaceeeeiiiinooooouuuuyy"
TOKEN = r"[a-z0-9_./:-]+"


def tokens(c: Column) -> Column:
    """Identifier-like tokens of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(text_or(c)), F.lit(TOKEN), F.lit(0))


def token_set(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def normalized(c: Column) -> Column:
    return F.array_join(tokens(c), " ")


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two arrays taken as sets; empty strings don't count, an empty side gives 0."""
    full = lambda x: F.filter(F.array_distinct(x), lambda v: v != "")
    both = F.size(F.array_intersect(full(a), full(b)))
    return F.when((F.size(full(a)) == 0) | (F.size(full(b)) == 0), 0.0).otherwise(both / F.size(F.array_union(full(a), full(b))))


def token_jaccard(a: Column, b: Column) -> Column:
    return jaccard(token_set(a), token_set(b))


def index_terms(c: Column) -> Column:
    """Terms of the keyword index: runs of letters and digits, lower case, accents folded."""
    low = F.lower(text_or(c))
    # Folding looks up each letter, so texts without accents are left as they are.
    folded = F.when(low.rlike(f"[{FOLD_FROM}]"), F.translate(low, FOLD_FROM, FOLD_TO)).otherwise(low)
    return F.regexp_extract_all(folded, F.lit(r"[a-z0-9\p{L}\p{N}\p{Co}]+"), F.lit(0))


def query_terms(c: Column) -> Column:
    """Terms of a keyword query: operators blanked, split at white space."""
    blanked = F.regexp_replace(text_or(c), r'["()*:^]', " ")
    return F.filter(F.split(collapse(blanked), " "), lambda t: t != "")


def index_text(title: Column, summary: Column, body: Column, keywords: Column) -> Column:
    """What the keyword index holds of a node: its non-empty parts joined by spaces."""
    parts = [F.nullif(text_or(c), F.lit("")) for c in (title, summary, body, F.array_join(keywords, " "))]
    return F.concat_ws(" ", *parts)


def chunks(c: Column, size: int, overlap: int) -> Column:
    """Overlapping character windows: array of (start, end, chunk), blank windows left out.

    The text is cut once into pieces of a window's step, of which each window puts some
    together, so the work grows with the text and not with its square.
    """
    size = max(1, size)
    step = size - max(0, min(overlap, size - 1))
    pieces = F.regexp_extract_all(text_or(c), F.lit(f"(?s).{{1,{step}}}"), F.lit(0))

    def windows(parts: Column) -> Column:
        n = (F.size(parts) - 1) * step + F.length(F.element_at(parts, -1))
        count = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step))).cast("int")
        put = lambda i: F.substring(F.array_join(F.slice(parts, i + 1, math.ceil(size / step)), ""), 1, size)
        every = F.filter(F.transform(F.sequence(F.lit(0), count), lambda i: F.struct((i * step).alias("start"), put(i).alias("chunk"))), lambda w: ~blank(w["chunk"]))
        return F.transform(every, lambda w: F.struct(w["start"].alias("start"), (w["start"] + F.length(w["chunk"])).alias("end"), w["chunk"].alias("chunk")))

    # The pieces are bound to a name, or they would be made again for each window.
    made = F.element_at(F.transform(F.array(pieces), windows), 1)
    return F.when(F.length(text_or(c)) == 0, F.array().cast("array<struct<start:int,end:int,chunk:string>>")).otherwise(made)


def frontmatter(c: Column) -> Column:
    """(meta map, body): key: value lines between --- fences; the body is stripped only where fences are."""
    pattern = r"(?s)^---\s*\n(.*?)\n---\s*\n(.*)$"
    there = c.rlike(pattern)
    lines = F.filter(F.split(F.regexp_extract(c, pattern, 1), "\n"), lambda line: F.contains(line, F.lit(":")))
    unquote = lambda v: F.regexp_replace(strip(v), "^[\"']+|[\"']+$", "")
    entries = F.transform(lines, lambda line: F.struct(strip(F.substring_index(line, ":", 1)).alias("key"), unquote(F.substring(line, F.instr(line, ":") + 1, F.length(line))).alias("value")))
    last = F.filter(F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), i.alias("i"))), lambda e: ~F.exists(F.slice(entries, e["i"] + 2, F.size(entries) + 1), lambda later: later["key"] == e["key"]))
    meta = F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))
    empty = F.create_map().cast("map<string,string>")
    return F.struct(F.when(there, meta).otherwise(empty).alias("meta"), F.when(there, strip(F.regexp_extract(c, pattern, 2))).otherwise(c).alias("body"))


def title_of(body: Column) -> Column:
    """The first line that begins with #, without the marks; null if it says nothing or none is there."""
    first = F.get(F.filter(F.split(body, "\n"), lambda line: F.startswith(strip(line), F.lit("#"))), F.lit(0))
    return F.nullif(strip(F.regexp_replace(strip(first), "^#+", "")), F.lit(""))


def humanize(name: Column) -> Column:
    """A folder name as a title: number prefix off, dashes as spaces, each word's first letter large, 80 at most."""
    spaced = strip(F.translate(F.regexp_replace(text_or(name), r"^\d+-", ""), "-", " "))
    # a letter is large after anything but a letter
    parts = F.regexp_extract_all(F.lower(spaced), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    titled = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), "")
    return F.coalesce(F.nullif(F.substring(titled, 1, 80), F.lit("")), F.lit("General"))


def document_name(c: Column) -> Column:
    return F.substring(or_else(collapse(text_or(c)), F.lit("untitled.md")), 1, 160)


def canonical_name(c: Column) -> Column:
    return F.regexp_replace(c, r"^\d+-", "")


def clean_optional(c: Column, most: int) -> Column:
    """White space collapsed, cut with an ellipsis beyond ``most``; null where nothing is left."""
    said = F.nullif(collapse(text_or(c)), F.lit(""))
    return F.when(F.length(said) > most, F.concat(F.rtrim(F.substring(said, 1, most - 1)), F.lit("…"))).otherwise(said)


def note_title(body: Column, origin: Column, question: Column) -> Column:
    """A note's title: the question, else the body's heading, else the origin without its agent: or human:, else the first line that says something."""
    asked = or_else(collapse(text_or(question)))
    said = strip(F.regexp_replace(text_or(origin), "^(agent|human):", ""))
    lines = F.transform(F.split(text_or(body), r"\r\n|[\n\r]"), lambda line: strip(F.regexp_replace(strip(line), "^#+", "")))
    first = F.get(F.filter(lines, lambda line: line != ""), F.lit(0))
    return F.coalesce(asked, or_else(title_of(body)), or_else(F.substring(said, 1, 80)), F.substring(first, 1, 80), F.lit("Agent note"))


#: What may stand around a node id: in front a bullet, quotes and "id:", behind it quotes, a title in brackets and further table cells.
BEFORE_REF, BEHIND_REF = r"\s*[-*]?[`'\"\s]*(?:id\s*:)?[`'\"\s,;]*", r"[`'\"\s,;]*(?:\s\([^)]*\))?[`'\"\s]*(?:\|.*)?"


def clean_node_ref(c: Column) -> Column:
    """A node id without what is put around it."""
    return F.regexp_extract(text_or(c), rf"(?isU)^{BEFORE_REF}([^|]*?){BEHIND_REF}$", 1)


def natural_number(name: Column) -> Column:
    """The number before the first dash, for sorting; a billion without one."""
    return F.coalesce(F.split(name, "-")[0].try_cast("bigint"), F.lit(10**9).cast("bigint"))


def parse_ranges(c: Column) -> Column:
    """Pairs of integers from JSON text [[a, b], ...]; malformed input and entries are left out."""
    found = F.from_json(c, "array<array<string>>")
    pairs = F.transform(F.filter(found, lambda p: F.size(p) == 2), lambda p: F.struct(p[0].try_cast("int").alias("start"), p[1].try_cast("int").alias("end")))
    return F.coalesce(F.filter(pairs, lambda p: p["start"].isNotNull() & p["end"].isNotNull()), F.array().cast("array<struct<start:int,end:int>>"))


def distinct_ignoring_case(c: Column, most: int) -> Column:
    """Values stripped, the first spelling of each kept, at most ``most``."""
    clean = F.filter(F.transform(c, strip), lambda v: v != "")
    lowered = F.transform(clean, F.lower)
    kept = F.filter(F.transform(clean, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda e: F.array_position(lowered, F.lower(e["v"])) == e["i"] + 1)
    return F.slice(F.transform(kept, lambda e: e["v"]), 1, most)


def extract_json(c: Column) -> Column:
    """The JSON in a reply: a fenced block, else from the first brace to the last, else brackets."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    brackets = F.regexp_extract(c, r"(?s)\[.*\]", 0)
    return or_else(strip(fenced), braces, brackets, strip(c))


# image units, images and diagrams

UNIT_OPEN, MEDIA = r"(?is)<image-unit\b[^>]*>", r"(?is)<image-media\b[^>]*>.*?</image-media>"
SAID = r"(?is)<image-description\b[^>]*>(.*?)</image-description>"


#: What stands for image units, media and inline data in text for an embedder. Fixed values.
DESCRIBED, UNDESCRIBED = ("\n\n[Embedded image description]\n", "\n[/Embedded image description]\n\n"), "\n\n[Embedded image omitted: no description available]\n\n"
NO_MEDIA, NO_DATA = "\n\n[Embedded image media omitted]\n\n", "data:image;base64,[omitted]"


def each_unit(c: Column, told: Callable[[Column], Column]) -> Column:
    """The text with the inside of each image unit put as ``told`` says.

    The text is cut at the ends of units, so that no unit reaches into the next.
    """
    parts = F.split(text_or(c), r"(?i)</image-unit>", -1)

    def unit(part: Column) -> Column:
        pieces = F.split(part, UNIT_OPEN, 2)
        body = F.get(pieces, F.lit(1))
        return F.when(body.isNull(), F.concat(part, F.lit("</image-unit>"))).otherwise(F.concat(F.get(pieces, F.lit(0)), told(body)))

    last = F.size(parts) - 1
    return F.array_join(F.transform(parts, lambda part, i: F.when(i < last, unit(part)).otherwise(part)), "")


def strip_image_media(c: Column) -> Column:
    """Image units become their descriptions, those without one what is in them beside media; media go everywhere."""
    told = lambda body: F.when(body.rlike(SAID), strip(F.regexp_extract(body, SAID, 1))).otherwise(strip(F.regexp_replace(body, MEDIA, "")))
    return F.regexp_replace(each_unit(c, told), MEDIA, "")


def embed_safe(c: Column) -> Column:
    """Text for an embedder: descriptions between marks; a mark for units without one, for media, and a redacted address for inline data."""
    said = lambda body: strip(F.regexp_extract(body, SAID, 1))
    told = lambda body: F.when(said(body) != "", F.concat(F.lit(DESCRIBED[0]), said(body), F.lit(DESCRIBED[1]))).otherwise(F.lit(UNDESCRIBED))
    bare = F.regexp_replace(each_unit(c, told), MEDIA, NO_MEDIA)
    return F.regexp_replace(bare, r"(?i)data:image/[a-z0-9.+-]+;base64,[A-Za-z0-9+/=\r\n]+", NO_DATA)


def images(c: Column) -> Column:
    """(alt, target) of every markdown image."""
    pattern = r"!\[([^\]]*)\]\(([^)]+)\)"
    alts, targets = (F.regexp_extract_all(c, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.zip_with(alts, targets, lambda a, t: F.struct(a.alias("alt"), markdown_target(t).alias("target")))


def markdown_target(c: Column) -> Column:
    """A link target without its title and angle brackets."""
    bare = F.regexp_replace(strip(c), "\\s+(\"[^\"]*\"|'[^']*')$", "")
    return F.regexp_replace(strip(bare), "^<|>$", "")


def is_remote(c: Column) -> Column:
    return c.rlike(r"(?i)^(?:https?:|data:|//)")


def without_query(c: Column) -> Column:
    return F.regexp_replace(c, r"[?#].*$", "")


def fence_lines(lines: Column) -> Column:
    """For every line, how many fence lines stand above it or are it."""
    fence = lambda line: F.when(F.regexp_like(line, F.lit(r"^\s*(?:```|~~~)")), 1).otherwise(0)
    start = F.array().cast("array<int>")
    return F.aggregate(lines, start, lambda acc, line: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + fence(line))))


def image_line_numbers(c: Column) -> Column:
    """Zero-based numbers of the lines that hold an image, outside fenced code."""
    lines = F.split(c, "\n")
    marked = F.zip_with(lines, fence_lines(lines), lambda line, n: F.struct(line.alias("line"), n.alias("n")))
    numbered = F.transform(marked, lambda m, i: F.struct(i.alias("i"), m["line"].alias("line"), m["n"].alias("n")))
    found = F.filter(numbered, lambda m: (m["n"] % 2 == 0) & F.regexp_like(m["line"], F.lit(r"!\[[^\]]*\]\([^)]+\)")))
    return F.transform(found, lambda m: m["i"])


def mermaid_blocks(c: Column) -> Column:
    blocks = F.regexp_extract_all(text_or(c), F.lit(r"(?is)```mermaid[ \t]*\r?\n(.*?)```"), F.lit(1))
    return F.filter(F.transform(blocks, strip), lambda b: b != "")


def numbered_context(c: Column, at: Column, before: int = 300, after: int = 10) -> Column:
    """Lines around one, numbered from 1, the line itself marked with an arrow."""
    lines = F.split(c, "\n")
    start = F.greatest(at - before, F.lit(0))
    window = F.slice(lines, start + 1, F.least(at + after, F.size(lines) - 1) - start + 1)
    return F.array_join(F.transform(window, lambda line, i: F.concat(F.when(start + i == at, F.lit(">> ")).otherwise(F.lit("   ")), (start + i + 1).cast("string"), F.lit(": "), line)), "\n")


def html_escape(c: Column) -> Column:
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    for raw, safe in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def html_unescape(c: Column) -> Column:
    out = c
    for raw, safe in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("'", "&#39;"), ("&", "&amp;")):
        out = F.replace(out, F.lit(safe), F.lit(raw))
    return out


def table_rows(c: Column) -> Column:
    """Rows of cells of an HTML table: tags off, entities read, bars escaped, line breaks as <br>."""
    rows = F.regexp_extract_all(c, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    def cell(x: Column) -> Column:
        broken = F.regexp_replace(x, r"(?i)<br\s*/?>", "\n")
        bare = strip(html_unescape(F.regexp_replace(broken, r"<[^>]+>", "")))
        return F.regexp_replace(F.replace(bare, F.lit("|"), F.lit("\\|")), r"\s*\n\s*", "<br>")
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>"), F.lit(1)), cell))


def table_markdown(c: Column) -> Column:
    """An HTML table as a markdown table; ragged rows are padded, the first row is the head."""
    rows = F.filter(table_rows(c), lambda r: F.size(r) > 0)
    width = F.array_max(F.transform(rows, F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.concat(F.array(line(F.get(rows, F.lit(0)))), F.array(rule), F.transform(F.slice(rows, 2, F.size(rows)), line))
    return F.when(F.size(rows) > 0, F.array_join(lines, "\n")).otherwise("")


def safe_image_source(c: Column) -> Column:
    return c.rlike(r"(?i)^(?:https?://|data:image/(?:png|jpe?g|gif|webp|svg\+xml);base64,|/)")


def coarse_key(cluster: Column) -> Column:
    """A short group name: "Chapter 26 ..." as "Ch 26", names up to 22 characters as they are, others Misc."""
    name = or_else(cluster, F.lit("Misc"))
    chapter = F.regexp_extract(name, r"(?i)^chapter\s+(\d+)", 1)
    return F.when(chapter != "", F.concat(F.lit("Ch "), chapter)).when(F.length(name) <= 22, name).otherwise("Misc")


def truncated(c: Column, most: int = 200) -> Column:
    """Long strings as a prefix and their length."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("… ("), F.length(c).cast("string"), F.lit(" chars)"))).otherwise(c)


def node_ref(id_: Column, title: Column, entity: Column) -> Column:
    return F.struct(id_.alias("id"), or_else(title, entity, id_).alias("title"))


def snippet(summary: Column, title: Column) -> Column:
    return strip(F.coalesce(or_else(summary, title), F.lit("")))


def fnv1a_unit(c: Column) -> Column:
    """FNV-1a over UTF-16 units as a number from 0 to 1 (units beyond the basic plane by code point)."""
    units = F.transform(F.filter(F.split(text_or(c), ""), lambda x: x != ""), F.ascii)
    step = lambda h, u: F.pmod(h.bitwiseXOR(u.cast("long")) * F.lit(16777619), F.lit(2**32))
    return F.aggregate(units, F.lit(2166136261).cast("long"), step) / F.lit(float(2**32))


def sse_frames(c: Column) -> Column:
    """The JSON of the data frames in a stream of server-sent events; comments are left out."""
    frames = F.transform(F.split(text_or(c), r"\r?\n\r?\n"), lambda f: F.array_join(F.transform(F.filter(F.split(f, r"\r?\n"), lambda line: F.startswith(line, F.lit("data:"))), lambda line: strip(F.substring(line, F.lit(6), F.length(line)))), "\n"))
    return F.filter(frames, lambda f: f != "")

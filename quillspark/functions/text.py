"""Text functions, as Catalyst expressions. Lengths are code points unless a name says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import trimmed

# Marks of generated files, in the first HEADER characters; average line of a minified file.
GENERATED_MARKS = ["CODE GENERATED", "DO NOT EDIT", "GENERATED FILE", "THIS FILE IS AUTOGENERATED", "THIS FILE WAS GENERATED", "AUTO-GENERATED", "AUTO GENERATED", "AUTOMATICALLY GENERATED", "GENERATED BY", "@GENERATED", "DO NOT MODIFY"]
HEADER, MINIFIED_LINE = 1000, 500
# First words of diagrams.
DIAGRAM_TYPES = ["graph", "flowchart", "sequencediagram", "classdiagram", "statediagram", "erdiagram", "gantt", "pie", "gitgraph", "mindmap", "timeline", "quadrantchart", "sankey", "block", "packet", "architecture"]


def is_generated(content: Column) -> Column:
    head = F.upper(F.left(content, F.lit(HEADER)))
    out = F.lit(False)
    for mark in GENERATED_MARKS:
        out = out | head.contains(mark)
    return out


def is_minified(content: Column) -> Column:
    return F.length(content) / F.size(F.split(content, "\n")) > MINIFIED_LINE


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def word_count(content: Column) -> Column:
    return F.size(F.filter(F.split(content, r"(?U)\s+"), lambda x: x != ""))


def html_escaped(c: Column) -> Column:
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def heading_id(heading: Column) -> Column:
    """Tags out, lower case, other characters as one hyphen, none at the ends."""
    plain = F.lower(F.regexp_replace(heading, "<[^>]+>", ""))
    return F.regexp_replace(F.regexp_replace(plain, r"[^\w]+", "-"), "^-|-$", "")


def heading_text(heading: Column) -> Column:
    """A heading for comparison: no marks, punctuation as a space, lower case."""
    plain = F.regexp_replace(F.regexp_replace(heading, r"[`*_~]+", ""), r"(?U)[^\p{L}\p{N}\s]+", " ")
    return F.lower(trimmed(F.regexp_replace(plain, r"(?U)\s+", " ")))


def without_title(content: Column, title: Column) -> Column:
    """The content without a first heading that repeats the title."""
    squeezed = lambda c: F.lower(F.regexp_replace(trimmed(c), r"(?U)\s+", " "))
    pattern = r"(?U)\A(\s*#\s+([^\n]+?)\s*\n+)"
    lead, heading = F.regexp_extract(content, pattern, 1), F.regexp_extract(content, pattern, 2)
    return F.when((lead != "") & (squeezed(heading) == squeezed(title)), F.substr(content, F.length(lead) + 1)).otherwise(content)


def embedded_json(text: Column) -> Column:
    """What lies between the first { and the last }, without code fences."""
    clean = F.regexp_replace(F.regexp_replace(text, "```json\n?", ""), "```\n?", "")
    body = F.regexp_extract(clean, r"(?s)(\{.*\})", 1)
    return trimmed(F.when(body != "", body).otherwise(clean))


def final_message(messages: Column) -> Column:
    """The last message that isn't blank, trimmed; empty if there is none."""
    said = F.filter(F.transform(messages, trimmed), lambda x: x != "")
    return F.coalesce(F.try_element_at(said, F.lit(-1)), F.lit(""))


def parsed_message(messages: Column) -> Column:
    """The JSON of the final message: as it is, else what is embedded in it; null if neither parses."""
    last = final_message(messages)
    return F.coalesce(F.try_parse_json(last), F.try_parse_json(embedded_json(last)))


def is_diagram(code: Column) -> Column:
    """Whether the first line begins with a diagram type."""
    return F.lower(trimmed(F.split(code, "\n")[0])).rlike("\\A(" + "|".join(DIAGRAM_TYPES) + ")")


def diagram_signature(code: Column) -> Column:
    """A diagram without comments, blank lines, case and spacing, its plain labels unquoted."""
    lines = F.filter(F.transform(F.split(code, "\n"), trimmed), lambda x: (x != "") & ~x.startswith("%%"))
    flat = F.regexp_replace(F.lower(F.array_join(lines, " ")), r"(?U)\s+", " ")
    return trimmed(F.regexp_replace(flat, r'\[\s*"\s*([a-z0-9 _-]+?)\s*"\s*\]', "[$1]"))


def tidy_diagram(code: Column) -> Column:
    """Arrows of three and more heads cut to two, quoted labels tight in matching brackets, labels with marks quoted."""
    out = F.regexp_replace(code, "->>>+", "->>")
    for a, b in (("\\[", "\\]"), ("\\{", "\\}"), ("\\(", "\\)")):
        out = F.regexp_replace(out, f'(^|[^\\w"])([A-Za-z][\\w-]*)({a})\\s*"([^"\\n]*)"\\s*({b})', '$1$2$3"$4"$5')
    return F.regexp_replace(out, r'(\w+)\[([^\]"]*[(),:;{}|<>][^\]"]*)\]', '$1["$2"]')


def clipped(content: Column, limit: int, note: str) -> Column:
    return F.when(F.length(content) > limit, F.concat(F.left(content, F.lit(limit)), F.lit(note))).otherwise(content)


def display_name(owner: Column, name: Column, show_owner: bool = True) -> Column:
    known = lambda c: F.coalesce(F.nullif(trimmed(c), F.lit("")), F.lit("unknown"))
    return F.concat(known(owner), F.lit("/"), known(name)) if show_owner else known(name)


def display_full_name(full: Column, show_owner: bool = True) -> Column:
    name = F.coalesce(F.nullif(trimmed(full), F.lit("")), F.lit("unknown"))
    if show_owner:
        return name
    return F.when(name.endswith("/"), name).otherwise(F.substring_index(name, "/", -1))

"""Wiki markup to Markdown and back, and wiki URLs, as regex rewrite chains."""

from pyspark.sql import Column, functions as F

from .text import trim

# Applied in this order.
TO_MARKDOWN = (
    (r"(?i)<style[^>]*>[\s\S]*?</style>", ""),
    (r"(?i)<script[^>]*>[\s\S]*?</script>", ""),
    (r"(?i)<h1[^>]*>([\s\S]*?)</h1>", "\n# $1\n"),
    (r"(?i)<h2[^>]*>([\s\S]*?)</h2>", "\n## $1\n"),
    (r"(?i)<h3[^>]*>([\s\S]*?)</h3>", "\n### $1\n"),
    (r"(?i)<h4[^>]*>([\s\S]*?)</h4>", "\n#### $1\n"),
    (r'(?i)<ac:structured-macro[^>]*ac:name="code"[^>]*>[\s\S]*?<ac:plain-text-body><!\[CDATA\[([\s\S]*?)\]\]></ac:plain-text-body>[\s\S]*?</ac:structured-macro>',
     "\n```\n$1\n```\n"),
    (r"(?i)<strong[^>]*>([\s\S]*?)</strong>", "**$1**"),
    (r"(?i)<b[^>]*>([\s\S]*?)</b>", "**$1**"),
    (r"(?i)<em[^>]*>([\s\S]*?)</em>", "*$1*"),
    (r"(?i)<code[^>]*>([\s\S]*?)</code>", "`$1`"),
    (r"(?i)<li[^>]*>([\s\S]*?)</li>", "- $1\n"),
    (r"(?i)</?[uo]l[^>]*>", "\n"),
    (r"(?i)<tr[^>]*>([\s\S]*?)</tr>", "|$1|\n"),
    (r"(?i)<t[hd][^>]*>([\s\S]*?)</t[hd]>", " $1 |"),
    (r"(?i)</?table[^>]*>", "\n"),
    (r"(?i)</?tbody[^>]*>", ""),
    (r'(?i)<a[^>]*href="([^"]*)"[^>]*>([\s\S]*?)</a>', "[$2]($1)"),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)<p[^>]*>([\s\S]*?)</p>", "$1\n\n"),
    (r"(?i)<div[^>]*>([\s\S]*?)</div>", "$1\n"),
    (r"<[^>]+>", ""),
    (r"&nbsp;", " "), (r"&amp;", "&"), (r"&lt;", "<"), (r"&gt;", ">"),
    (r"\n{3,}", "\n\n"),
)

HEADINGS_AND_EMPHASIS = (
    (r"(?m)^### (.+)$", "<h3>$1</h3>"), (r"(?m)^## (.+)$", "<h2>$1</h2>"), (r"(?m)^# (.+)$", "<h1>$1</h1>"),
    (r"\*\*(.+?)\*\*", "<strong>$1</strong>"), (r"\*(.+?)\*", "<em>$1</em>"),
)
CODE_MACRO = ('<ac:structured-macro ac:name="code"><ac:parameter ac:name="language">',
              "</ac:parameter><ac:plain-text-body><![CDATA[", "]]></ac:plain-text-body></ac:structured-macro>")
INLINE_AND_LISTS = (
    (r"`([^`]+)`", "<code>$1</code>"), (r"(?m)^[\*\-] (.+)$", "<li>$1</li>"),
    (r"((?:<li>.*</li>\n?)++)", "<ul>$1</ul>"),
)
PARAGRAPHS = (
    (r"((?:<tr>.*</tr>\n?)++)", "<table><tbody>$1</tbody></table>"), (r"\n\n", "</p><p>"),
)
PARAGRAPH_REPAIR = (
    (r"<p></p>", ""), (r"<p>(<h[1-6]>)", "$1"), (r"(</h[1-6]>)</p>", "$1"), (r"<p>(<ul>)", "$1"), (r"(</ul>)</p>", "$1"),
    (r"<p>(<table>)", "$1"), (r"(</table>)</p>", "$1"), (r"<p>(<ac:structured-macro)", "$1"),
    (r"(</ac:structured-macro>)</p>", "$1"),
)


def rewrite(s: Column, rules) -> Column:
    for pattern, replacement in rules:
        s = F.regexp_replace(s, pattern, replacement)
    return s


def to_markdown(html: Column) -> Column:
    return trim(rewrite(html, TO_MARKDOWN))


def _pieces(s: Column, pattern: str, make) -> Column:
    """Replace every match by make(match text): gaps and matches interleaved again."""
    whole = F.regexp_extract_all(s, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.split(s, pattern, -1)
    return F.array_join(F.zip_with(gaps, whole, lambda g, m: F.concat(
        F.coalesce(g, F.lit("")), F.when(m.isNotNull(), make(m)).otherwise(F.lit("")))), "")


def _code(m: Column) -> Column:
    lang = F.coalesce(F.nullif(F.regexp_extract(m, r"^```(\w+)?\n", 1), F.lit("")), F.lit("text"))
    body = F.regexp_extract(m, r"^```(?:\w+)?\n([\s\S]+?)```$", 1)
    return F.concat(F.lit(CODE_MACRO[0]), lang, F.lit(CODE_MACRO[1]), trim(body), F.lit(CODE_MACRO[2]))


def _row(m: Column) -> Column:
    cells = F.filter(F.transform(F.split(F.substr(m, F.lit(2), F.length(m) - 2), r"\|"), trim),
                     lambda c: (F.length(c) > 0) & ~c.rlike("^[-:]+$"))
    return F.when(F.size(cells) == 0, F.lit("")).otherwise(F.concat(
        F.lit("<tr>"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))), ""), F.lit("</tr>")))


def to_wiki(markdown: Column) -> Column:
    s = rewrite(markdown, HEADINGS_AND_EMPHASIS)
    s = _pieces(s, r"```(?:\w+)?\n[\s\S]+?```", _code)
    s = rewrite(s, INLINE_AND_LISTS)
    s = _pieces(s, r"\|.+\|", _row)
    s = rewrite(s, PARAGRAPHS)
    return rewrite(F.concat(F.lit("<p>"), s, F.lit("</p>")), PARAGRAPH_REPAIR)


def page_id(url: Column) -> Column:
    u = F.regexp_replace(trim(url), "^<|>$", "")
    found = [F.nullif(F.regexp_extract(u, p, 1), F.lit("")) for p in (r"/pages/(\d+)", r"pageId=(\d+)", r"/edit-v2/(\d+)")]
    return F.when(F.contains(u, F.lit("http")), F.coalesce(*found))


def base_url(url: Column) -> Column:
    u = F.regexp_replace(trim(url), "^<|>$", "")
    return F.nullif(F.regexp_extract(u, r"(https?://[^/]+/wiki)", 1), F.lit(""))


def document_header(name, fmt, pages, sheets) -> Column:
    """Header block put before an extracted document's text."""
    return F.concat(
        F.lit("[Document: "), name, F.lit("]\n[Format: "), fmt, F.lit("]\n"),
        F.when(pages > 0, F.concat(F.lit("[Pages: "), pages.cast("string"), F.lit("]\n"))).otherwise(F.lit("")),
        F.when(sheets > 0, F.concat(F.lit("[Sheets: "), sheets.cast("string"), F.lit("]\n"))).otherwise(F.lit("")),
        F.lit("\n"))

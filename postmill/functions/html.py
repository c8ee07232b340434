"""Text of HTML fragments, and job descriptions embedded in pages."""

from __future__ import annotations

import html
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fragments held as Python texts at once.
RUN = 200

# Elements whose text is no page text.
HIDDEN = frozenset({"script", "style", "template"})

JSON_LD_SCRIPT = (
    r"(?is)<script\b[^>]*\btype\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script\s*>"
)


class _Texts(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0
        self.buffer: list[str] = []

    def _cut(self) -> None:
        text = "".join(self.buffer).strip()
        if text:
            self.parts.append(text)
        self.buffer.clear()

    def handle_starttag(self, tag, attrs):
        self._cut()
        if tag in HIDDEN:
            self.hidden += 1

    def handle_startendtag(self, tag, attrs):
        self._cut()

    def handle_endtag(self, tag):
        self._cut()
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1

    def handle_comment(self, data):
        self._cut()

    def handle_decl(self, decl):
        self._cut()

    def handle_pi(self, data):
        self._cut()

    def handle_data(self, data):
        if not self.hidden:
            self.buffer.append(data)


def fragment_text(raw: str) -> str:
    """Text nodes joined by newlines, each stripped, empty ones dropped."""
    parser = _Texts()
    parser.feed(html.unescape(raw))
    parser.close()
    parser._cut()
    return "\n".join(parser.parts)


def fragment_texts(raw: pa.Array) -> pa.Array:
    """``fragment_text`` of every fragment; few are Python texts at a time, whatever the batch."""
    runs = [
        pa.array([None if x is None else fragment_text(x) for x in raw.slice(start, RUN).to_pylist()], pa.string())
        for start in range(0, len(raw), RUN)
    ]
    return pa.concat_arrays(runs) if runs else pa.array([], pa.string())


@F.arrow_udf(StringType())
def _html_to_text(raw: pa.Array) -> pa.Array:
    return fragment_texts(raw)


def html_to_text(raw: Column | str) -> Column:
    """Plain text of HTML that may itself be entity-escaped; null stays null."""
    return _html_to_text(F.col(raw) if isinstance(raw, str) else raw)


def html_or_blank(raw: Column | str) -> Column:
    return F.coalesce(html_to_text(raw), F.lit(""))


def json_ld_description_html(page: Column | str) -> Column:
    """Description HTML of the first JobPosting object in a page's JSON-LD.

    Blocks that are no JSON, no object or another type are passed over.
    """
    body = F.col(page) if isinstance(page, str) else page
    blocks = F.regexp_extract_all(body, F.lit(JSON_LD_SCRIPT), F.lit(1))
    parsed = F.transform(blocks, lambda b: F.try_parse_json(b))
    postings = F.filter(
        parsed,
        lambda v: F.coalesce(
            F.try_variant_get(v, '$["@type"]', "string") == "JobPosting", F.lit(False)
        ),
    )
    first = F.get(postings, F.lit(0))
    return F.coalesce(F.try_variant_get(first, "$.description", "string"), F.lit(""))


def json_ld_description(page: Column | str) -> Column:
    return html_or_blank(json_ld_description_html(page))

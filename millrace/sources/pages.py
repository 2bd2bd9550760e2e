"""Page parsing with the standard library's HTML parser, in Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "titles array<string>, disambiguation boolean, paragraphs array<string>"


class _Page(HTMLParser):
    """Texts of <p> and <li>, titles of search hits, scripts and styles left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.texts, self.titles, self._open, self._skip, self._hit = [], [], 0, 0, 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self._skip += 1
        elif tag in ("p", "ul"):
            if not self._open:
                self.texts.append("")
            self._open += 1
        if "mw-search-result-heading" in (dict(attrs).get("class") or ""):
            self._hit += 1
            self.titles.append("")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self._skip = max(0, self._skip - 1)
        elif tag in ("p", "ul"):
            self._open = max(0, self._open - 1)
        elif tag == "div":
            self._hit = max(0, self._hit - 1)

    def handle_data(self, data):
        if self._skip:
            return
        if self._open:
            self.texts[-1] += data
        if self._hit:
            self.titles[-1] += data


def parse(html: str | None) -> tuple[list[str], bool, list[str]]:
    """(up to five hit titles, whether the page only lists meanings, texts of more than two words)."""
    p = _Page()
    p.feed(html or "")
    texts = [" ".join(t.split()) for t in p.texts]
    return [" ".join(t.split()) for t in p.titles][:5], any("may refer to:" in t for t in texts), [t for t in texts if len(t.split()) > 2]


def read(pages: DataFrame, html: str = "html") -> DataFrame:
    """The pages' columns but for the source, and what was parsed."""

    @F.pandas_udf(SCHEMA)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(x) for x in s], columns=["titles", "disambiguation", "paragraphs"])

    return pages.withColumn("__p", run(html)).select(*[c for c in pages.columns if c != html], "__p.*")

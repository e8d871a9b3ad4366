"""URL verdicts: host and path rules first, then a weighted vocabulary found by Aho-Corasick.

One pass over the URL finds every term of the vocabulary. A hit counts only if no ASCII letter or digit stands right
before or after it. A URL is blocked on one strict term, or on `soft_needed` distinct soft terms; inflections of a term are no distinct ones.

Edge cases: a null URL, or one without ://, has an empty host and path and no rule; its verdict is the vocabulary's. An
empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ids_schema

#: The vocabulary. Strict terms block alone, soft ones only together; behind a term stand its inflections.
STRICT = (("adult",), ("casino", "casinos"), ("escort", "escorts"), ("gambling",), ("hentai",), ("phishing",), ("poker",), ("porn", "porno", "pornography"), ("sex",), ("spam",), ("viagra",), ("warez",), ("xxx",))
SOFT = (("ad", "ads", "advert", "adverts"), ("bet", "bets", "betting"), ("bonus", "bonuses"), ("buy",), ("cheap", "cheapest"), ("click", "clicks"), ("deal", "deals"), ("farm",), ("free",), ("jackpot", "jackpots"), ("lottery", "lotto"), ("nude", "nudes"), ("pill", "pills"), ("popup", "popups"), ("promo", "promos"), ("slot", "slots"), ("track", "tracker", "tracking"), ("win", "winner", "winners"))
#: Fixed values: (rule, verdict). A rule is a host and the beginning of a path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def split_url(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path)."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    stop = min((k for c in "?#" if (k := rest.find(c)) >= 0), default=len(rest))
    host, slash, path = rest[:stop].partition("/")
    return host.translate(_LOWER), slash + path


@dataclass
class UrlFilter:
    strict: tuple[tuple[str, ...], ...] = STRICT
    soft: tuple[tuple[str, ...], ...] = SOFT
    rules: tuple[tuple[str, str], ...] = RULES
    soft_needed: int = 2
    _automaton: ahocorasick.Automaton = field(init=False, repr=False)

    def __post_init__(self):
        self._automaton = ahocorasick.Automaton()
        for terms, is_strict in ((self.soft, False), (self.strict, True)):
            for forms in terms:
                for form in forms:
                    self._automaton.add_word(form, (len(form), forms[0], is_strict))
        self._automaton.make_automaton()
        # By host, the longest path first.
        self._by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in sorted(self.rules, key=lambda x: -len(x[0])):
            host, slash, path = rule.partition("/")
            self._by_host.setdefault(host, []).append((slash + path, rule, verdict))

    def hits(self, url: str | None) -> tuple[int, set[str]]:
        """How many strict hits, and which soft terms."""
        text = (url or "").translate(_LOWER)
        strict, soft = 0, set()
        for last, (size, term, is_strict) in self._automaton.iter(text) if text else ():
            first = last - size
            if (first < 0 or text[first] not in _WORD) and (last + 1 == len(text) or text[last + 1] not in _WORD):
                if is_strict:
                    strict += 1
                else:
                    soft.add(term)
        return strict, soft

    def rule(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits, and its verdict."""
        best: tuple[str | None, str | None] = (None, None)
        while host:
            for prefix, rule, verdict in self._by_host.get(host, ()):
                if path.startswith(prefix) and len(rule) > len(best[0] or ""):
                    best = (rule, verdict)
            host = host.partition(".")[2]
        return best

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, int, int]:
        host, path = split_url(url)
        rule, verdict = self.rule(host, path)
        strict, soft = self.hits(url)
        return host, path, rule, verdict or ("block" if strict or len(soft) >= self.soft_needed else "allow"), strict, len(soft)


def filter_urls(pages: DataFrame, settings: UrlFilter | None = None, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """For each row its id, `host`, `path`, `rule`, `verdict`, `strict_hits` and `soft_terms` (how many distinct ones)."""
    settings = settings or UrlFilter()
    given = (settings.strict, settings.soft, settings.rules, settings.soft_needed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = UrlFilter(*given).judge
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
        for batch in batches:
            rows = list(zip(*map(judge, batch.column(1).to_pylist()), strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(rows, kinds, strict=True))], [id_column, "host", "path", "rule", "verdict", "strict_hits", "soft_terms"])

    return pages.select(id_column, url_column).mapInArrow(run, f"{ids_schema(pages, id_column)}, host string, path string, rule string, verdict string, strict_hits int, soft_terms int")


def oracle_sql() -> str:
    """The same verdicts of `pages` by DuckDB's regular expressions."""
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    term = lambda x: f"regexp_matches(low, '(^|[^a-z0-9])({'|'.join(x)})([^a-z0-9]|$)')"
    fits = [(f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '/{p}')", rule, verdict) for rule, verdict in sorted(RULES, key=lambda x: -len(x[0])) for h, _, p in [rule.partition("/")]]
    soft = " + ".join(f"cast({term(t)} as int)" for t in SOFT)
    strict = " + ".join(f"cast({term(t)} as int)" for t in STRICT)
    return f"""
with r as (select page_id, {lower("coalesce(url, '')")} as low, case when strpos(url, '://') > 0 then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') else '' end as rest from pages),
h as (select page_id, low, {lower("regexp_extract(rest, '^[^/]*')")} as host, substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) as path from r),
j as (select page_id, host, path, case {" ".join(f"when {f} then '{r}'" for f, r, _ in fits)} end as rule, case {" ".join(f"when {f} then '{v}'" for f, _, v in fits)} end as ruled, {soft} as soft, {strict} as strict from h)
select page_id, host, path, rule, coalesce(ruled, case when strict > 0 or soft >= 2 then 'block' else 'allow' end) as verdict from j"""

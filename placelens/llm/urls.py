"""URL filters: a weighted vocabulary of strict and soft terms, after explicit host and path rules."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

# A strict term rejects by itself, a soft one has a weight and needs others beside it.
STRICT_TERMS = ("adult", "casino", "hentai", "porn", "porno", "viagra", "xxx")
SOFT_TERMS = {
    "bet": 1.0, "bets": 1.0, "bonus": 0.5, "buy": 0.5, "cheap": 1.0, "dating": 1.0, "deal": 0.5, "discount": 0.5,
    "escort": 1.5, "free": 1.0, "girls": 1.0, "hot": 0.5, "jackpot": 1.5, "loan": 1.0, "nude": 1.5, "pharmacy": 1.0,
    "pills": 1.0, "poker": 1.5, "replica": 1.0, "sex": 1.5, "slots": 1.5, "torrent": 1.0, "warez": 1.5, "win": 1.0,
}
# Distinct soft terms whose weights add up to this reject; no single term reaches it.
SOFT_LIMIT = 2.0

COLUMNS = "host string, path string, rule string, verdict string, strict_hits int, soft_hits int, soft_weight double"


@dataclass(frozen=True)
class Rule:
    """Pages of a host and its subdomains whose path starts with `path` are allowed or blocked."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(verdict, host, slash + path)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    ends = [i for i in map(rest.find, "/?#") if i >= 0]
    at = min(ends, default=len(rest))
    host, rest = rest[:at], rest[at:]
    ends = [i for i in map(rest.find, "?#") if i >= 0]
    return host.encode().lower().decode(), rest[: min(ends, default=len(rest))]


class UrlJudge:
    """Rules by host suffix, and one automaton over all terms; made once in each task."""

    def __init__(self, rules: Iterable[Rule], strict: Iterable[str], soft: dict[str, float], limit: float) -> None:
        import ahocorasick

        self.rules: dict[str, list[Rule]] = {}
        for rule in sorted(rules, key=lambda r: (-len(r.text), -len(r.host))):
            self.rules.setdefault(rule.host, []).append(rule)
        self.automaton = ahocorasick.Automaton()
        for term, weight in soft.items():
            self.automaton.add_word(term, (term, weight))
        for term in strict:
            self.automaton.add_word(term, (term, None))
        self.has_terms = len(self.automaton) > 0
        self.automaton.make_automaton()
        self.limit = limit

    def rule_of(self, host: str, path: str) -> Rule | None:
        labels = host.split(".")
        fits = [
            rule
            for i in range(len(labels))
            for rule in self.rules.get(".".join(labels[i:]), [])
            if path.startswith(rule.path)
        ]
        return max(fits, key=lambda r: (len(r.text), len(r.host)), default=None)

    def hits(self, url: str) -> tuple[set[str], dict[str, float]]:
        """Distinct strict and soft terms that stand between characters other than ASCII letters and digits."""
        strict: set[str] = set()
        soft: dict[str, float] = {}
        if not self.has_terms:
            return strict, soft
        text = url.encode().lower().decode()
        for last, (term, weight) in self.automaton.iter(text):
            before, after = text[last - len(term) : last - len(term) + 1], text[last + 1 : last + 2]
            if last - len(term) < 0:
                before = ""
            if any(c.isascii() and c.isalnum() for c in (before, after) if c):
                continue
            if weight is None:
                strict.add(term)
            else:
                soft[term] = weight
        return strict, soft

    def judge(self, url: str | None) -> tuple:
        host, path = split_url(url)
        strict, soft = self.hits(url or "")
        weight = float(sum(soft[t] for t in sorted(soft)))
        rule = self.rule_of(host, path)
        if rule:
            verdict = rule.verdict
        else:
            verdict = "block" if strict or weight >= self.limit else "allow"
        return host, path, rule.text if rule else None, verdict, len(strict), len(soft), weight


def judge_urls(
    pages: DataFrame,
    id_column: str,
    url_column: str,
    rules: Iterable[Rule] = (),
    strict: Iterable[str] = STRICT_TERMS,
    soft: dict[str, float] | None = None,
    limit: float = SOFT_LIMIT,
) -> DataFrame:
    """One row per page: its id, host, path, rule, verdict and term hits.

    The longest fitting rule decides. Without one, a page is blocked by one
    strict term or by distinct soft terms whose weights reach `limit`; terms
    count once each, only between non-alphanumeric characters, anywhere in the
    URL. A page is judged by itself, so the job is one scan without a shuffle;
    rules and terms travel with the tasks and are a setting, not data.

    Null URLs and those without `://` have an empty host and path (so no rule
    fits unless its host is empty); a null URL is allowed. Repeated rows give
    repeated results, an empty table an empty one, a null id stays null; other
    columns of `pages` are not read, so their names cannot clash.
    """
    settings = (tuple(rules), tuple(strict), dict(SOFT_TERMS if soft is None else soft), limit)
    kind = dict(pages.dtypes)[id_column]
    schema = f"`{id_column}` {kind}, {COLUMNS}"

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = UrlJudge(*settings)
        types = [pa.string()] * 4 + [pa.int32()] * 2 + [pa.float64()]
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        for batch in batches:
            columns = list(zip(*map(judge.judge, batch.column(1).to_pylist()), strict=True)) or [[]] * len(types)
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [id_column, *names])

    return pages.select(id_column, pages[url_column].cast("string")).mapInArrow(judged, schema)

"""URL filters as one bit-parallel automaton.

All glob rules are packed, one after the other, into the bits of a few 64-bit
words. A bit stands for "the rule matched up to here"; one Shift-And step over
all words advances every rule by one byte of the URL, and a second mask keeps
the bits that wait in a wildcard. A batch of URLs is stepped together, the longest
first, so that finished URLs drop off the end. Cost is bytes x words, whatever
the number of rules that match.

Globs: ``*`` any run of characters without ``/``, ``**`` any run, ``?`` one
character that is not ``/``; everything else stands for itself. A glob is
matched against the whole canonical URL: ``.`` + host + path.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole


@dataclass(frozen=True)
class Rule:
    name: str
    glob: str
    verdict: str

    @classmethod
    def site(cls, verdict: str, host_path: str) -> Rule:
        """A host with its subdomains, and a path prefix: ``example.com/en/``."""
        return cls(host_path, f"*.{host_path}**", verdict)


#: Hosts that a crawl of prose does without: what the registered query uses.
JUNK_GLOBS = tuple(
    Rule(f"junk:{g}", g, "block")
    for g in (
        "*casino*/**", "*cheap-pills*/**", "*free-bets*/**", "*adult-x*/**", "*spam-farm*/**", "*ads-track*/**",
        "*casino*", "*cheap-pills*", "*free-bets*", "*adult-x*", "*spam-farm*", "*ads-track*",
    )
)

#: What a crawl of prose does without unless its own table of rules says otherwise (rules_of): words in a host, services by
#: their first label, folders of machinery and accounts, and endings of files that hold no page. A glob meets ``.host/path``.
JUNK_HOST_WORDS = ("casino", "poker", "gambl", "betting", "free-bets", "jackpot", "porn", "xxx", "adult-x", "escort", "cheap-pills", "viagra", "pharmacy-online", "payday-loan", "spam-farm", "ads-track", "adserver", "warez", "torrent")
JUNK_SERVICES = ("ad", "ads", "adclick", "track", "tracker", "tracking", "pixel", "beacon", "click", "redirect", "cdn", "static", "img", "mail", "webmail", "login", "auth", "sso")
JUNK_FOLDERS = ("cgi-bin", "wp-admin", "wp-login*", "wp-json", "xmlrpc*", "login*", "signin*", "signup*", "register*", "logout*", "account", "cart", "checkout", "search", "tag", "tags", "feed", "rss", "print", "calendar")
JUNK_ENDINGS = ("jpg", "jpeg", "png", "gif", "svg", "ico", "css", "js", "json", "xml", "zip", "gz", "exe", "mp3", "mp4", "avi", "woff?", "ttf")


def _junk() -> Iterator[str]:
    for word in JUNK_HOST_WORDS:
        yield f".*{word}*"
        yield f".*{word}*/**"
    for name in JUNK_SERVICES:
        yield f".{name}.*"
        yield f".{name}.*/**"
    for name in JUNK_FOLDERS:
        yield f".*/{name}"
        yield f".*/{name}/**"
        yield f".*/**/{name}"
        yield f".*/**/{name}/**"
    for ending in JUNK_ENDINGS:
        yield f".*/**.{ending}"


#: A wider list than JUNK_GLOBS, to be given as glob_rules.
STOCK_GLOBS = tuple(Rule(f"junk:{g}", g, "block") for g in _junk())


def rules_of(table: DataFrame, glob_col: str = "glob", verdict_col: str = "verdict") -> tuple[Rule, ...]:
    """Glob rules from a table (glob, verdict), in the order of the globs; rows without a glob are left out, a null verdict blocks.

    The rules are a list that each task holds, some hundred bits a rule: thousands, not millions.
    """
    rows = table.where(F.col(glob_col).isNotNull()).select(glob_col, F.coalesce(verdict_col, F.lit("block"))).distinct().orderBy(glob_col).collect()
    return tuple(Rule(g, g, v) for g, v in rows)


class ShiftAnd:
    """The packed automaton of a list of globs."""

    def __init__(self, globs: Sequence[str]):
        items: list[tuple[np.ndarray | None, np.ndarray]] = []  # for each bit: bytes that enter it, bytes that stay in it
        none, any_byte = np.zeros(256, bool), np.ones(256, bool)
        segment = any_byte.copy()
        segment[ord("/")] = False
        starts, ends = [], []
        for glob in globs:
            starts.append(len(items))
            items.append((none, none.copy()))
            raw, i = glob.encode(), 0
            while i < len(raw):
                if raw[i : i + 1] == b"*":
                    deep = raw[i : i + 2] == b"**"
                    items[-1] = (items[-1][0], items[-1][1] | (any_byte if deep else segment))
                    i += 1 + deep
                    continue
                enter = none.copy()
                if raw[i : i + 1] == b"?":
                    enter |= segment
                else:
                    enter[raw[i]] = True
                items.append((enter, none.copy()))
                i += 1
            ends.append(len(items) - 1)
        self.words = max(1, -(-len(items) // 64))
        self.enter, self.stay = np.zeros((256, self.words), np.uint64), np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        bit = lambda j: np.uint64(1 << (j % 64))
        for j, (enter, stay) in enumerate(items):
            self.enter[enter, j // 64] |= bit(j)
            self.stay[stay, j // 64] |= bit(j)
        for j in starts:
            self.start[j // 64] |= bit(j)
        self.ends = [(j // 64, bit(j)) for j in ends]

    def run(self, urls: Sequence[bytes]) -> np.ndarray:
        """Boolean matrix: which URL matches which glob."""
        n = len(urls)
        out = np.zeros((n, len(self.ends)), bool)
        length = np.fromiter(map(len, urls), np.int64, n)
        # so many rows at once that their padded matrix stays small, however long one URL is
        order = np.argsort(-length, kind="stable")
        at = 0
        while at < n:
            width = int(length[order[at]])
            rows = order[at : at + max(1, min(n, (4 << 20) // max(1, width)))]
            at += len(rows)
            size = length[rows]
            chars = np.frombuffer(b"".join(urls[r].ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width) if width else np.zeros((len(rows), 0), np.uint8)
            state = np.tile(self.start, (len(rows), 1))
            active = np.searchsorted(-size, -np.arange(width), side="left")  # rows longer than t: a prefix, as sizes descend
            for t in range(width):
                k = int(active[t])
                s, c = state[:k], chars[:k, t]
                moved = s << np.uint64(1)
                if self.words > 1:
                    moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
                state[:k] = (moved & self.enter[c]) | (s & self.stay[c])
            for g, (w, b) in enumerate(self.ends):
                out[rows, g] = (state[:, w] & b) != 0
        return out


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def filter_urls(
    pages: DataFrame,
    site_rules: Sequence[Rule],
    glob_rules: Sequence[Rule] = JUNK_GLOBS,
    url_col: str = "url",
    id_col: str = "page_id",
    default: str = "allow",
) -> DataFrame:
    """id, host, path, rule, verdict, matched (the name of the rule that decided, or null).

    Of the site rules that match, the longest decides and is named in ``rule``;
    without one, any matching glob rule decides (the first in the list), else
    ``default``. A null URL, or one without ``://``, has an empty host and path and
    matches no site rule. Repeated rows are judged alike. Other columns are not read.
    """
    rules = [*site_rules, *glob_rules]
    n_sites = len(site_rules)
    machine = ShiftAnd([r.glob for r in rules])
    longest_first = sorted(range(n_sites), key=lambda i: -len(site_rules[i].name))
    order = np.array([*longest_first, *range(n_sites, len(rules))], dtype=np.int64)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hit = machine.run([f".{h}{p}".encode("utf-8", "replace") for h, p in zip(pdf["host"], pdf["path"], strict=True)])[:, order]
            first = np.where(hit.any(axis=1), hit.argmax(axis=1), -1)
            chosen = [rules[order[i]] if i >= 0 else None for i in first]
            yield pdf.assign(
                rule=[r.name if r and 0 <= i < n_sites else None for r, i in zip(chosen, first, strict=True)],
                verdict=[r.verdict if r else default for r in chosen],
                matched=[r.name if r else None for r in chosen],
            )

    url = whole(url_col)
    rows = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, matched string")

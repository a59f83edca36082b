"""URL rules matched by a bit-parallel wildcard automaton.

Every rule becomes anchored globs over the canonical URL (lower-cased host, then path). In a glob
``*`` stands for any run without ``/`` and ``**`` for any run. A glob of m literal bytes owns m+1
neighbouring bits, "j literals seen"; all globs are packed side by side into 64-bit words, and a
bit's move into the next glob's first bit is never allowed. One Shift-And step per byte position
advances all globs for all URLs of a batch at once: ``D = shift(D) & move[byte] | D & stay[byte]``,
with the carry taken across words.

Defined results: a null URL, or one without ``://``, has an empty host and path and fits no rule of
a named host; where no rule fits, ``rule`` is null and the verdict is the default. Of several rules
that fit the one with the longest text wins, ties going to ``block`` and then to the smaller text.
Repeated rows are judged alike, an empty table gives an empty table, and columns of the input that are
named like those of the output are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of automaton state held at once; a batch of URLs is cut into runs of this size.
STATE_WORDS = 1 << 20


class Rule(NamedTuple):
    verdict: str  #: ``block`` or ``allow``
    host: str  #: fits this host and its subdomains; may hold ``*``
    path: str  #: beginning of the path; may hold ``*`` and ``**``

    @property
    def text(self) -> str:
        return self.host + self.path


class GlobSet:
    """Globs packed into multiword Shift-And masks."""

    def __init__(self, globs: Sequence[str]):
        parts = [re.findall(rb"\*\*|\*|[^*]", g.encode(), re.S) for g in globs]
        size = sum(1 + sum(p[:1] != b"*" for p in glob) for glob in parts)
        self.words = max(1, -(-size // 64))
        self.move = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.first = np.zeros(self.words, np.uint64)
        self.last: list[tuple[int, int]] = []
        not_slash = [b for b in range(256) if b != ord("/")]
        at = 0
        for glob in parts:
            self._set(self.first, at)
            for part in glob:
                if part[:1] == b"*":
                    for b in not_slash if part == b"*" else range(256):
                        self._set(self.stay[b], at)
                else:
                    at += 1
                    self._set(self.move[part[0]], at)
            self.last.append(divmod(at, 64))
            at += 1

    @staticmethod
    def _set(mask: np.ndarray, bit: int) -> None:
        mask[bit // 64] |= np.uint64(1 << bit % 64)

    def first_match(self, texts: Sequence[bytes]) -> np.ndarray:
        """For each text the smallest index of a glob that matches all of it, or -1."""
        out = np.full(len(texts), -1, np.int64)
        step = max(1, STATE_WORDS // self.words)
        for a in range(0, len(texts), step):
            out[a : a + step] = self._run(texts[a : a + step])
        return out

    def _run(self, texts: Sequence[bytes]) -> np.ndarray:
        lengths = np.array([len(x) for x in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(texts), np.uint8)
        starts = (np.cumsum(lengths) - lengths)[order]
        longest = -lengths[order]
        state = np.tile(self.first, (len(texts), 1))
        one, top = np.uint64(1), np.uint64(63)
        for t in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(longest, -t, "left"))  # those longer than t
            byte, old = data[starts[:live] + t], state[:live]
            shifted = old << one
            shifted[:, 1:] |= old[:, :-1] >> top
            state[:live] = shifted & self.move[byte] | old & self.stay[byte]
        hits = np.zeros((len(texts), len(self.last) + 1), bool)
        hits[:, -1] = True
        for k, (word, bit) in enumerate(self.last):
            hits[:, k] = (state[:, word] >> np.uint64(bit)) & one
        found = hits.argmax(axis=1)
        out = np.empty(len(texts), np.int64)
        out[order] = np.where(found == len(self.last), -1, found)
        return out


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def judge(df: DataFrame, rules: Sequence[Rule], default: str, url: str = "url") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict``."""
    ranked = sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block", r.text))
    globs = [glob for r in ranked for glob in (f"{r.text}**", f"*.{r.text}**")]
    shared = df.sparkSession.sparkContext.broadcast(GlobSet(globs))
    names, verdicts = [r.text for r in ranked], [r.verdict for r in ranked]

    @F.arrow_udf(T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())]))
    def fit(urls: pa.Array) -> pa.Array:
        found = (shared.value.first_match([x.encode() for x in urls.to_pylist()]) // 2).tolist()
        rule = pa.array([names[k] if k >= 0 else None for k in found], pa.string())
        verdict = pa.array([verdicts[k] if k >= 0 else default for k in found], pa.string())
        return pa.StructArray.from_arrays([rule, verdict], ["rule", "verdict"])

    column = F.col(f"`{url}`")
    parsed = df.withColumns({"host": host(column), "path": path(column)})
    return parsed.withColumn("rule", fit(F.concat("host", "path"))).withColumns({"verdict": F.col("rule.verdict"), "rule": F.col("rule.rule")})

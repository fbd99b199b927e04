"""Operator 7: bit-parallel wildcard automaton over URLs.

A glob rule has literal bytes, ``?`` for any byte and ``*`` for any run. All rules are packed
into one row of 64-bit words, a state per atom; one step of Shift-And moves all rules at once
over the next byte of every URL of an Arrow batch. A state before ``*`` keeps itself.

The canonical form is ``.host`` + NUL + path, so rules can tell a host's end. Host and path
rules become globs ``*.host NUL path*``; of those that fit, the longest wins. Where none fits,
a URL is blocked if one of the content globs fits, else allowed. Null URLs and URLs without
``://`` have empty host and path and are allowed; repeated rows are judged alike; an empty
table gives no rows. NULs in a URL are dropped. Long URLs cost one step per byte.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesmith.llm.common import lower_ascii, whole

#: Verdict, host, path.
RULES = [
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
]
#: What is blocked where no rule fits.
GLOBS = ["*\0/*login*", "*\0/*/cart/*", "*\0*.exe", "*\0*.zip", "*\0*.apk", "*.ads.*\0*", "*\0*/wp-admin/*"]


class Automaton:
    """All globs as bit masks over the bytes of a URL."""

    def __init__(self, globs: list[str]):
        atoms, self.first, self.last = [], [], []
        loops = []
        for glob in globs:
            self.first.append(len(atoms))
            atoms.append(None)
            loops.append(False)
            for b in glob.encode():
                if b == ord("*"):
                    loops[-1] = True
                else:
                    atoms.append(b)
                    loops.append(False)
            self.last.append(len(atoms) - 1)
        n = self.words = (len(atoms) + 63) // 64 or 1
        self.start, self.loop = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.step = np.zeros((256, n), np.uint64)
        for i, atom in enumerate(atoms):
            bit = np.uint64(1) << np.uint64(i % 64)
            if loops[i]:
                self.loop[i // 64] |= bit
            if atom is None:
                self.start[i // 64] |= bit
            elif atom == ord("?"):
                self.step[:, i // 64] |= bit
            else:
                self.step[atom, i // 64] |= bit

    def match(self, texts: list[bytes]) -> np.ndarray:
        """A row of booleans per text, one per glob."""
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        ends = np.cumsum(lengths)
        begins = (ends - lengths)[order]
        data = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
        state = np.repeat(self.start[None, :], len(texts), 0)
        live = len(texts)
        for t in range(int(lengths.max(initial=0))):
            while live and lengths[order[live - 1]] <= t:
                live -= 1
            now = state[:live]
            shifted = now << np.uint64(1)
            shifted[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (shifted & self.step[data[begins[:live] + t]]) | (now & self.loop)
        out = np.zeros((len(texts), len(self.last)), bool)
        for k, i in enumerate(self.last):
            out[order, k] = (state[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1) == 1
        return out


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(whole(url), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(whole(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge(
    pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, globs: list[str] = GLOBS,
    id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """``id, host, path, rule, verdict`` of every page."""
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    automaton = Automaton([f"*.{host}\0{path}*" for _, host, path in ranked] + globs)
    n = len(ranked)

    @F.pandas_udf("rule int, blocked boolean")
    def run(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        got = automaton.match([f".{h}\0{p}".encode() for h, p in zip(hosts, paths, strict=True)])
        fits = got[:, :n]
        return pd.DataFrame({
            "rule": np.where(fits.any(1), fits.argmax(1), -1) if n else np.full(len(got), -1), "blocked": got[:, n:].any(1),
        })

    parts = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    clean = [F.replace(F.col(c), F.lit("\0"), F.lit("")) for c in ("host", "path")]
    names = F.array(*[F.lit(host + path) for _, host, path in ranked], F.lit(None).cast("string"))
    verdicts = F.array(*[F.lit(v) for v, _, _ in ranked], F.lit(None).cast("string"))
    at = F.col("_got.rule")
    return parts.withColumn("_got", run(*clean)).select(
        id_col, "host", "path", F.when(at >= 0, F.get(names, at)).alias("rule"),
        F.when(at >= 0, F.get(verdicts, at)).when(F.col("_got.blocked"), "block").otherwise("allow").alias("verdict"),
    )

"""URL rules as one bit-parallel wildcard automaton.

Every rule is a glob over a canonical form of the URL. All states of all globs are packed side by
side in 64-bit words; one Shift-And step per character moves them all at once, for a whole batch
of URLs. ``*`` is a state that stays where it is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm.common import pick

#: Ends the host in the canonical form ".host" + END + "path".
END = "\x00"
#: Stands for a NUL of the URL, which is no END. UTF-8 has no such byte.
NUL = b"\xff"


class GlobAutomaton:
    """Matches many globs at once. ``*`` is any run of characters other than END, ``**`` any run at all,
    ``?`` one character other than END; everything else stands for itself. Texts are byte strings."""

    def __init__(self, globs: Sequence[str]) -> None:
        self.size = len(globs)
        starts, finals, steps, loops = [], [], [], []
        state = 0
        for glob in globs:
            starts.append(state)
            data, i = glob.encode(), 0
            while i < len(data):
                if data[i : i + 2] == b"**":
                    loops.append((state, True))
                    i += 2
                elif data[i : i + 1] == b"*":
                    loops.append((state, False))
                    i += 1
                else:
                    state += 1
                    steps.append((state, None if data[i : i + 1] == b"?" else data[i]))
                    i += 1
            finals.append(state)
            state += 1
        self.words = words = state // 64 + 1
        self.step = np.zeros((256, words), np.uint64)  # states entered on a byte
        self.stay = np.zeros((256, words), np.uint64)  # states that may stay on it
        self.start = np.zeros(words, np.uint64)
        self.final = [(s // 64, np.uint64(s % 64)) for s in finals]
        bit = lambda s: (s // 64, np.uint64(1) << np.uint64(s % 64))
        for s in starts:
            w, b = bit(s)
            self.start[w] |= b
        for s, byte in steps:
            w, b = bit(s)
            which = [c for c in range(256) if c != ord(END)] if byte is None else byte
            self.step[which, w] |= b
        for s, anything in loops:
            w, b = bit(s)
            which = slice(None) if anything else [c for c in range(256) if c != ord(END)]
            self.stay[which, w] |= b

    def match(self, texts: Sequence[bytes]) -> np.ndarray:
        """A row per text, a column per glob: whether the glob fits the whole text."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        lengths = np.array([len(texts[i]) for i in order])
        flat = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
        states = np.tile(self.start, (len(texts), 1))
        one, top = np.uint64(1), np.uint64(63)
        live = len(texts)
        for at in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(-lengths[:live], -at))  # texts longer than ``at`` come first
            now, byte = states[:live], flat[starts[:live] + at]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            states[:live] = (moved & self.step[byte]) | (now & self.stay[byte])
        out = np.zeros((len(texts), self.size), bool)
        for k, (w, b) in enumerate(self.final):
            out[order, k] = (states[:, w] >> b) & one != 0
        return out


def canonical(host: str, path: str) -> bytes:
    host, path = (x.encode().replace(END.encode(), NUL) for x in (host, path))
    return b"." + host + END.encode() + path


def rule_glob(rule: str) -> str:
    """host/path: the host and its subdomains, and paths that start with the rule's."""
    host, _, path = rule.partition("/")
    return f"*.{host}{END}/{path}**"


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str]], globs: Sequence[str], id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """(page_id, host, path, rule, verdict) per row.

    ``rules`` are (verdict, "host/path"); the longest that fits decides, of equally long ones the first.
    Where none fits, a URL is blocked if one of ``globs`` fits its canonical form. Host: what
    follows the first "://" up to "/", "?", "#" or the end, A-Z in lower case; path: then up to "?",
    "#" or the end; both are empty if the url is null or has no "://". Repeated rows are judged each;
    an empty table gives no rows.
    """
    after = F.expr("substring(url, instr(url, '://') + 3)")
    rest = F.when(F.instr("url", "://") > 0, after).otherwise(F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rows = pick(pages, page_id=id_col, url=url_col).withColumn("rest", rest)
    rows = rows.select(
        "page_id", F.translate(F.regexp_extract("rest", r"(?s)^([^/?#]*)", 1), upper, lower).alias("host"),
        F.regexp_extract("rest", r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"),
    )
    ranked = sorted(rules, key=lambda r: -len(r[1]))
    automaton = GlobAutomaton([*(rule_glob(r) for _, r in ranked), *globs])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                canonical(h.as_py(), p.as_py()) for h, p in zip(batch.column("host"), batch.column("path"), strict=True)
            ]
            fits = automaton.match(texts)
            ruled, extra = fits[:, : len(ranked)], fits[:, len(ranked) :].any(axis=1)
            first = np.where(ruled.any(axis=1), ruled.argmax(axis=1), -1).tolist()
            rule = pa.array([ranked[i][1] if i >= 0 else None for i in first], pa.string())
            verdict = [ranked[i][0] if i >= 0 else "block" if bad else "allow" for i, bad in zip(first, extra, strict=True)]
            yield batch.append_column("rule", rule).append_column("verdict", pa.array(verdict, pa.string()))

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string")

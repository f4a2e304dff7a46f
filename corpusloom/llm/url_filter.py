"""URL rules in a sorted digest array: 64-bit xxHash keys, binary search, string check.

The rules are sorted by the xxHash of ``host + path`` and laid out as three flat files
(keys, string offsets, string bytes) in the shared folder. A task maps the files, builds
for its URLs every (host suffix, path prefix of a rule's length) string, hashes them and
probes the key array with one vectorised binary search for the batch. A hit counts only
if the stored string is equal, so a digest collision changes nothing.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path:
from there up to ``?``, ``#`` or the end. A null URL or one without ``://`` has an empty
host and path, which no rule fits. A rule fits its host and every subdomain, for paths
that start with the rule's path; the longest rule string wins (of equally long ones the
one with the longer host). URLs that no rule fits get ``default``. Repeated rule strings
must agree; empty tables give empty results.

The rule files are read by memory map, so the workers of a machine share their pages; the
driver checks ``max_rules`` before it sorts them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import fresh_path

#: Rules of the contract: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
SEED = 0


def build_index(spark: SparkSession, rules: Iterable[tuple[str, str, str]], max_rules: int = 20_000_000) -> str:
    """Write the digest array of the rules; the folder that holds it."""
    found: dict[tuple[str, str], str] = {}
    for host, path, verdict in rules:
        if not host or verdict not in ("allow", "block"):
            raise ValueError(f"bad rule: {(host, path, verdict)}")
        if found.setdefault((host.lower(), path), verdict) != verdict:
            raise ValueError(f"rules disagree: {host}{path}")
        if len(found) > max_rules:
            raise ValueError(f"over {max_rules} rules")
    rows = [(h.encode(), p.encode(), v == "block") for (h, p), v in found.items()]
    keys = np.array([xxhash.xxh64_intdigest(h + p, SEED) for h, p, _ in rows], dtype="<u8")
    order = np.argsort(keys, kind="stable")
    strings = [rows[i][0] + rows[i][1] for i in order]
    offsets = np.zeros(len(rows) + 1, dtype="<i8")
    np.cumsum([len(x) for x in strings], out=offsets[1:])
    parts = {
        "keys": keys[order].tobytes(),
        "offsets": offsets.tobytes(),
        "hosts": np.array([len(rows[i][0]) for i in order], dtype="<i4").tobytes(),
        "block": np.array([rows[i][2] for i in order], dtype="u1").tobytes(),
        "strings": b"".join(strings),
    }
    target = fresh_path(spark, "url-rules")
    fs, base = pafs.FileSystem.from_uri(target)
    fs.create_dir(base, recursive=True)
    for name, data in parts.items():
        with fs.open_output_stream(f"{base}/{name}") as out:
            out.write(data)
    return target


class DigestArray:
    """The rule files of one folder, mapped into memory where the store is a file system."""

    KINDS = {"keys": "<u8", "offsets": "<i8", "hosts": "<i4", "block": "u1", "strings": "u1"}

    def __init__(self, folder: str):
        fs, base = pafs.FileSystem.from_uri(folder)
        for name, kind in self.KINDS.items():
            if isinstance(fs, pafs.LocalFileSystem):
                data = np.memmap(f"{base}/{name}", dtype=kind, mode="r") if fs.get_file_info(f"{base}/{name}").size else np.empty(0, kind)
            else:
                data = np.frombuffer(fs.open_input_stream(f"{base}/{name}").readall(), dtype=kind)
            setattr(self, name, data)
        lengths = np.diff(self.offsets) - self.hosts
        self.path_lengths = sorted(set(lengths.tolist()))
        self.most_labels = max((self.string(i)[: self.hosts[i]].count(b".") + 1 for i in range(len(self.keys))), default=0)

    def string(self, i: int) -> bytes:
        return self.strings[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def find(self, probes: list[bytes], host_lengths: list[int]) -> np.ndarray:
        """For each probe the index of the rule with that host and path, or -1."""
        out = np.full(len(probes), -1, dtype=np.int64)
        if not probes or not len(self.keys):
            return out
        keys = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in probes), dtype=np.uint64, count=len(probes))
        at = np.searchsorted(self.keys, keys)
        ok = at < len(self.keys)
        ok[ok] = self.keys[at[ok]] == keys[ok]
        for i in np.flatnonzero(ok):
            j = at[i]
            while j < len(self.keys) and self.keys[j] == keys[i]:  # equal digests lie side by side
                if self.hosts[j] == host_lengths[i] and self.string(j) == probes[i]:
                    out[i] = j
                    break
                j += 1
        return out

    def judge(self, hosts: list[str], paths: list[str], default: str) -> tuple[list[str | None], list[str]]:
        probes, sizes, owner = [], [], []
        for row, (host, path) in enumerate(zip(hosts, paths)):
            if not host:
                continue
            h, p = host.encode(), path.encode()
            labels = h.split(b".")
            for k in range(max(0, len(labels) - self.most_labels), len(labels)):
                suffix = b".".join(labels[k:])
                for n in self.path_lengths:
                    if n <= len(p):
                        probes.append(suffix + p[:n])
                        sizes.append(len(suffix))
                        owner.append(row)
        best: dict[int, tuple[int, int, int]] = {}
        found = self.find(probes, sizes)
        for i in np.flatnonzero(found >= 0):
            rank = (len(probes[i]), sizes[i], int(found[i]))
            best[owner[i]] = max(best.get(owner[i], rank), rank)
        rules: list[str | None] = [None] * len(hosts)
        verdicts = [default] * len(hosts)
        for row, (_, _, j) in best.items():
            rules[row] = self.string(j).decode()
            verdicts[row] = "block" if self.block[j] else "allow"
        return rules, verdicts


@lru_cache(maxsize=2)
def _opened(folder: str) -> DigestArray:
    return DigestArray(folder)


def filter_urls(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: id, host, path, rule, verdict."""
    whole = F.col("url").contains("://")
    rest = F.when(whole, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    # (?s) as a URL may hold line breaks
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    parts = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url")).select(
        "id", F.translate(host, upper, lower).alias("host"), path.alias("path")
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _opened(folder)
        for b in batches:
            rules, verdicts = index.judge(b.column(1).to_pylist(), b.column(2).to_pylist(), default)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
                names=[id_col, "host", "path", "rule", "verdict"],
            )

    return parts.mapInArrow(judge, f"{id_col} long, host string, path string, rule string, verdict string")

"""URL filter over a sorted digest array.

Rules (``host/path`` strings with a verdict) are kept as three flat arrays: 64-bit xxhash keys in
ascending order, the end offsets of the full strings in the same order, and the strings' bytes. The
file is memory-mapped by each worker; a batch of probes is one vectorised binary search, and every
hit is confirmed against the stored string, so that equal digests of different strings do no harm.

A rule fits its host and all subdomains if the url's path starts with the rule's path. The longest
rule that fits wins; urls that no rule fits get the default verdict. A host is probed by each of its
suffixes that start at a label, with each path length that occurs among the rules.

The array is shipped with the job's files (``addFile``). A list that would make a file larger than
``MAX_FILE_BYTES`` is cut into several by ranges of digests, each mapped on its own, so that what a worker
holds in memory are the pages that its probes touch. The files are removed when the driver ends.

Defined cases: null urls, and urls without ``://``, have an empty host and path and get the default;
an empty rule list gives every row the default; other columns of the input are ignored, whatever
their names.
"""

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAGIC = b"DGST0001"
MAX_FILE_BYTES = 512 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the production filter.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)


def digest(keys: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))


class DigestArray:
    """The read side: sorted digests, string ends, strings, and one value byte for each."""

    def __init__(self, digests: np.ndarray, ends: np.ndarray, values: np.ndarray, blob: np.ndarray):
        self.digests, self.ends, self.values, self.blob = digests, ends, values, blob

    @staticmethod
    def build(entries: list[tuple[str, int]], path: str, limit: int = MAX_FILE_BYTES) -> list[str]:
        """Writes the file, or path.1, path.2, ... of at most ``limit`` bytes (or one digest) each; returns the paths. A string given twice keeps its last value."""
        keys = list(dict(entries))
        values, raw = dict(entries), [k.encode() for k in keys]
        found = digest(raw)
        order = np.argsort(found, kind="stable")
        cost = np.cumsum([17 + len(raw[i]) for i in order], dtype=np.int64)
        cuts, low = [0], 0
        while low < len(order):
            spent = int(cost[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(cost, spent + limit - 16, "right")))
            while high < len(order) and found[order[high]] == found[order[high - 1]]:  # equal digests stay together
                high += 1
            cuts.append(high)
            low = high
        paths = []
        for a, b in zip(cuts, cuts[1:], strict=False) if len(cuts) > 1 else [(0, 0)]:
            own = order[a:b]
            paths.append(path if len(cuts) <= 2 else f"{path}.{len(paths) + 1}")
            ends = np.cumsum([len(raw[i]) for i in own], dtype=np.uint64) if len(own) else np.zeros(0, np.uint64)
            with open(paths[-1], "wb") as out:
                out.write(MAGIC + np.uint64(len(own)).tobytes())
                out.write(found[own].tobytes() + ends.tobytes())
                out.write(np.array([values[keys[i]] for i in own], np.uint8).tobytes())
                out.write(b"".join(raw[i] for i in own))
        return paths

    @classmethod
    def open(cls, path: str) -> "DigestArray":
        """Maps the file; nothing is read until it is probed."""
        flat = np.memmap(path, np.uint8, "r")
        if flat[:8].tobytes() != MAGIC:
            raise ValueError(f"{path} is no digest array")
        n = int(flat[8:16].view(np.uint64)[0])
        a, b, c = 16 + 8 * n, 16 + 16 * n, 16 + 17 * n
        return cls(flat[16:a].view(np.uint64), flat[a:b].view(np.uint64), flat[b:c], flat[c:])

    def probe(self, keys: list[bytes]) -> np.ndarray:
        """For each key its entry's number, or -1. All keys are searched at once; runs of equal digests are walked."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.digests) or not keys:
            return out
        wanted = digest(keys)
        at = np.searchsorted(self.digests, wanted)
        hits = np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == wanted)
        for i in hits:
            j = int(at[i])
            while j < len(self.digests) and self.digests[j] == wanted[i]:
                if self.string(j) == keys[i]:
                    out[i] = j
                    break
                j += 1
        return out

    def string(self, j: int) -> bytes:
        return self.blob[int(self.ends[j - 1]) if j else 0 : int(self.ends[j])].tobytes()


def probe_all(arrays: list[DigestArray], keys: list[bytes]) -> list[tuple[int, int] | None]:
    """For each key (array, entry's number), or None."""
    out: list[tuple[int, int] | None] = [None] * len(keys)
    for k, array in enumerate(arrays):
        found = array.probe(keys)
        for i in np.flatnonzero(found >= 0).tolist():
            out[i] = k, int(found[i])
    return out


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)), F.lit(""))


def suffixes(host: str) -> list[str]:
    """The host and its parents, the longest first."""
    out, at = [host], host.find(".")
    while at >= 0:
        out.append(host[at + 1 :])
        at = host.find(".", at + 1)
    return out


def judge(urls: DataFrame, rules=RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``urls`` (page_id, url)."""
    verdicts = sorted({v for _, v in rules})
    entries = [(r, verdicts.index(v)) for r, v in rules]
    lengths = sorted({len(r) - r.index("/") for r, _ in rules})
    folder = tempfile.mkdtemp(prefix="digests-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    paths = DigestArray.build(entries, f"{folder}/digests-{uuid.uuid4().hex}.bin")  # a job's files can't be replaced under their name
    for path in paths:
        urls.sparkSession.sparkContext.addFile(path)
    names = [os.path.basename(path) for path in paths]

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        arrays = [DigestArray.open(SparkFiles.get(name)) for name in names]
        for batch in batches:
            keys: list[bytes] = []
            owner: list[int] = []
            for i, (host, path) in enumerate(zip(batch["host"], batch["path"], strict=True)):
                for suffix in suffixes(host):
                    for n in lengths:
                        if len(path) >= n:
                            keys.append(f"{suffix}{path[:n]}".encode())
                            owner.append(i)
            best: dict[int, tuple[int, int, int]] = {}
            for k, hit in enumerate(probe_all(arrays, keys)):
                if hit:
                    best[owner[k]] = max(best.get(owner[k], (-1, -1, -1)), (len(keys[k]), *hit))
            rule = [arrays[best[i][1]].string(best[i][2]).decode() if i in best else None for i in range(len(batch))]
            verdict = [verdicts[arrays[best[i][1]].values[best[i][2]]] if i in best else default for i in range(len(batch))]
            yield batch.assign(rule=pd.Series(rule, batch.index, dtype=object), verdict=pd.Series(verdict, batch.index, dtype=object))

    url = F.col("url")
    parts = urls.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"))
    return parts.mapInPandas(probe, "page_id long, host string, path string, rule string, verdict string")

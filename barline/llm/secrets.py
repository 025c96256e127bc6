"""Secret scan with corpus-wide ownership: who else has the same value decides what a candidate is.

A pass over the texts finds candidates by pattern. Their values are hashed, and the hashes are aggregated over the
corpus by distinct repository and owner. A value that several owners or very many repositories have is a widely copied
example; a value of one owner, in few repositories, that looks drawn at random is taken for a live credential. A value
between these, as in more repositories of one owner than one uses a credential in, gets no verdict.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.tables import saved

# Fixed by the contract; letters of the keyword in either case, ASCII only.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of [0-9a-f] of that length is found whole, so no shorter match hides it
KINDS = ("assign", "access", "hex", "example", "live")

PLACEHOLDER = re.compile(r"example|sample|dummy|change_?me|placeholder|your|test|x{4}|0{6}|1234", re.IGNORECASE | re.ASCII)
SPAN = "array<struct<kind:int,start:int,end:int,value_start:int,value_end:int,value:string,drawn:boolean>>"


def looks_drawn(value: str, least_length: int = 16, least_bits: float = 3.0) -> bool:
    """Long, with digits, of high entropy, and without the words that placeholders have."""
    if len(value) < least_length or not any(c.isdigit() for c in value) or PLACEHOLDER.search(value):
        return False
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values()) >= least_bits


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(kind, start, end, value start, value end) in code points, ordered by start, then kind."""
    out = [(0, *m.span(), *m.span(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(1, *m.span(), *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(2, *m.span(), *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], x[0]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums, spans = [], []
        for text in batch.column("text").to_pylist():
            text, row = text or "", []
            for kind, start, end, a, b in base_spans(text):
                value = text[a:b]
                digest = hashlib.sha256(value.encode()).hexdigest()
                row.append((kind, start, end, a, b, digest, looks_drawn(value)))
            spans.append([dict(zip(("kind", "start", "end", "value_start", "value_end", "value", "drawn"), x, strict=True)) for x in row])
            sums.append(hashlib.sha256(",".join(f"{KINDS[x[0]]}:{x[1]}:{x[2]}" for x in row).encode()).hexdigest())
        fields = [("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value_start", pa.int32()), ("value_end", pa.int32()), ("value", pa.string()), ("drawn", pa.bool_())]
        keep = [batch.column(c) for c in ("row_id", "doc_id", "repository", "owner")]
        yield pa.RecordBatch.from_arrays(
            [*keep, pa.array(sums, pa.string()), pa.array(spans, pa.list_(pa.struct(fields)))],
            ["row_id", "doc_id", "repository", "owner", "base_sha256", "found"],
        )


def scan_secrets(docs: DataFrame, repository: str = "source", owner: str = "source", wide_owners: int = 3, wide_repositories: int = 50, few_repositories: int = 5) -> DataFrame:
    """Per row of docs (doc_id, text, the columns named by `repository` and `owner`; others are ignored):
    doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_example, n_live, repositories, owners.

    `spans` lists kind:start:end, ordered by start, then kind, comma-joined. Besides the base kinds, `example` marks a
    value that `wide_owners` or more owners or `wide_repositories` or more repositories have, `live` a value of one owner
    in at most `few_repositories` that looks drawn at random; both span the value alone. repositories and owners are those
    of the row's most widely spread value, 0 without spans. An owner's name up to its first slash counts. Null and empty
    texts have no spans; a null repository or owner counts as one more, unnamed; repeated rows are one owner's and each
    gets its own result, a null doc_id stays null. Texts are read whole, at any length; of matches that begin together
    the kind listed first comes first. An empty table gives an empty result.
    """
    given = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        "doc_id",
        "text",
        F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"),
        F.substring_index(F.coalesce(F.col(owner).cast("string"), F.lit("")), "/", 1).alias("owner"),
    )
    scanned = saved(
        given.mapInArrow(_scan, f"row_id long, doc_id long, repository string, owner string, base_sha256 string, found {SPAN}"),
        "secrets",
    )
    each = scanned.where(F.size("found") > 0).select("row_id", "repository", "owner", F.explode("found").alias("s")).select("row_id", "repository", "owner", "s.*")
    spread = (
        each.select("value", "repository", "owner")
        .distinct()
        .groupBy("value")
        .agg(F.count_distinct("repository").alias("repositories"), F.count_distinct("owner").alias("owners"))
    )
    # Written, so that the join below has a plain exchange on both sides and a value that many rows have can be split.
    spread = saved(spread, "spread")
    told = each.join(spread, "value").withColumn(
        "verdict",
        F.when((F.col("owners") >= wide_owners) | (F.col("repositories") >= wide_repositories), 3).when(
            (F.col("owners") == 1) & (F.col("repositories") <= few_repositories) & F.col("drawn"), 4
        ),
    )
    both = F.array_compact(
        F.array(
            F.struct("start", "kind", "end"),
            F.when(
                F.col("verdict").isNotNull(),
                F.struct(F.col("value_start").alias("start"), F.col("verdict").alias("kind"), F.col("value_end").alias("end")),
            ),
        )
    )
    names = F.array(*map(F.lit, KINDS))
    listed = (
        told.select("row_id", "repositories", "owners", F.explode(both).alias("s"))
        .groupBy("row_id")
        .agg(F.array_sort(F.collect_set("s")).alias("all"), F.max("repositories").alias("repositories"), F.max("owners").alias("owners"))
        .select(
            "row_id",
            "all",
            "repositories",
            "owners",
            F.concat_ws(
                ",", F.transform("all", lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
            ).alias("spans"),
        )
    )
    count = lambda column, kind: F.size(F.filter(column, lambda s: s["kind"] == kind)).cast("long")
    return scanned.join(listed, "row_id", "left").select(
        "doc_id",
        *(count("found", k).alias(f"n_{KINDS[k]}") for k in range(3)),
        "base_sha256",
        F.coalesce("spans", F.lit("")).alias("spans"),
        *(F.coalesce(count("all", k), F.lit(0)).alias(f"n_{KINDS[k]}") for k in (3, 4)),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("repositories", "owners")),
    )

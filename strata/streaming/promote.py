"""Landing to silver, only the files that have not been processed yet."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.files import exists
from strata.operators.clean import drop_duplicates
from strata.sinks import snapshots
from strata.sinks.layers import BATCH_LEVELS, layer_path, write_layer

#: The hash that the files of the ledger are sorted by, and the batch that wrote a key.
HASH, BATCH = "_hash", "_batch"
#: Row groups are small, and their Bloom filters let through one hash in 10,000 that they lack.
LEDGER = {
    "parquet.bloom.filter.enabled#_hash": "true", "parquet.bloom.filter.adaptive.enabled": "true",
    "parquet.bloom.filter.fpp#_hash": "0.0001", "parquet.block.size": str(1 << 20),
}
#: Micro-batches of up to so many keys look their hashes up; larger ones are joined with the whole ledger.
LOOK_UP = 20_000
#: Hashes that one clause of the filter on the ledger holds, for a range of the hash space.
AT_ONCE = 500


def new_rows(batch: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in the table yet.

    The existing keys are first cut down to those of the batch. When the batch is small Spark
    broadcasts it there, and the large table is scanned for its keys but not shuffled.
    """
    seen = existing.select(*keys).join(batch.select(*keys), list(keys), "left_semi").distinct()
    return batch.join(seen, list(keys), "left_anti")


def _ledger_rows(rows: DataFrame, keys: Sequence[str], batch_id: Column) -> DataFrame:
    return rows.select(F.xxhash64(*keys).alias(HASH), *keys, batch_id.alias(BATCH))


def store_keys(rows: DataFrame, ledger: str, keys: Sequence[str], batch_id: str, fan: int = snapshots.FAN) -> None:
    """Add the keys of a batch to the ledger, in the place of those of an earlier attempt; merge parts of like size.

    The last batch of each stream keeps a part of its own, since it may be repeated. Merging is a commit of its own, and
    left undone if another writer was faster.
    """
    spark = rows.sparkSession
    named = _ledger_rows(rows, keys, F.lit(batch_id)).sortWithinPartitions(HASH)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in named.schema.fields])
    added = snapshots.write_parts(named, ledger, tags={"batch": batch_id}, options=LEDGER)
    while True:
        earlier = [p for p in snapshots.latest(spark, ledger).parts if p.tags["batch"] == batch_id]
        if snapshots.commit(spark, ledger, added, earlier, schema) is not None:
            break
    now = snapshots.latest(spark, ledger)
    streams = {}
    for p in now.parts:
        number, _, stream = p.tags["batch"].partition("-")
        streams[stream] = max(number, streams.get(stream, ""))
    settled = [p for p in now.parts if not p.tags["batch"] or streams[p.tags["batch"].partition("-")[2]] != p.tags["batch"].partition("-")[0]]
    for group in snapshots.tiers(settled, fan):
        files = max(1, sum(p.bytes for p in group) >> 27)
        together = snapshots.read_parts(spark, ledger, now, group)
        merged = together.repartitionByRange(files, HASH).sortWithinPartitions(HASH)
        snapshots.commit(spark, ledger, snapshots.write_parts(merged, ledger, tags={"batch": ""}, options=LEDGER), group)


def known_keys(rows: DataFrame, ledger: str, keys: Sequence[str], batch_id: str, look_up: int = LOOK_UP) -> DataFrame:
    """Keys of other batches among which all those of `rows` that the ledger holds are found.

    Of a small micro-batch the hashes are brought to the driver (`look_up` at most) and become a filter, with one clause
    for each range of sorted hashes. Ranges and Bloom filters of the row groups then leave most of the ledger unread,
    as new keys are in none of them. For a larger micro-batch the ledger's keys are read and joined.
    """
    spark = rows.sparkSession
    now = snapshots.latest(spark, ledger)
    known = snapshots.read_parts(spark, ledger, now).filter(F.col(BATCH) != batch_id)
    found = sorted({r[0] for r in rows.select(F.xxhash64(*keys)).limit(look_up + 1).collect()})
    if len(found) > look_up:
        return known.select(*keys)
    if not found:
        return known.filter(F.lit(False)).select(*keys)
    groups = [found[begin : begin + AT_ONCE] for begin in range(0, len(found), AT_ONCE)]
    wanted = [f"({HASH} BETWEEN {g[0]} AND {g[-1]} AND {HASH} IN ({', '.join(map(str, g))}))" for g in groups]
    return known.filter(" OR ".join(wanted)).select(*keys)


def _start_ledger(rows: DataFrame, ledger: str, target: str, keys: Sequence[str], batch_id: str) -> None:
    """The ledger of a table from before it: the table's keys are read once."""
    spark, kinds = rows.sparkSession, {f.name: f.dataType for f in rows.schema.fields}
    fields = [T.StructField(k, kinds[k]) for k in keys]
    silver = spark.read.schema(T.StructType([*fields, T.StructField("batch_id", T.StringType())])).parquet(target)
    named = _ledger_rows(silver.filter(F.col("batch_id") != batch_id), keys, F.col("batch_id").cast("string"))
    sorted_rows = named.repartitionByRange(HASH).sortWithinPartitions(HASH)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in named.schema.fields])
    snapshots.commit(spark, ledger, snapshots.write_parts(sorted_rows, ledger, tags={"batch": ""}, options=LEDGER), schema=schema)


def promote(
    spark: SparkSession,
    root: str,
    source: str,
    dataset: str,
    steps: Callable[[DataFrame], DataFrame],
    checkpoint: str,
    ts: str,
    schema: T.StructType | str,
    fmt: str = "json",
    keys: Sequence[str] | None = None,
    order_by: Sequence[str] | None = None,
    max_files: int = 1000,
) -> str:
    """Apply `steps` to the new landing files and write them to the silver path; returns that path.

    The checkpoint remembers which files are done, so a second run without new files adds nothing. With `keys`, a
    key is written once: the first by `order_by` within a micro-batch, and no key that an earlier batch
    wrote. Those keys lie in a ledger beside the table (`_keys`), see `known_keys`; the table itself is never read. A micro-batch that is repeated after a failure has the same batch id:
    it is not compared with its own first attempt but replaces it. The id of the stream is part of the batch id, so
    a new checkpoint replaces nothing that another one wrote.
    """
    target = layer_path(root, "silver", source, dataset)
    ledger = f"{layer_path(root, 'silver', source, dataset)}_keys"
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    levels = set(BATCH_LEVELS) - set(fields.names)
    stream: list[str] = []

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        if not stream:
            stream.append(json.loads(session.read.text(f"{checkpoint}/metadata").first()[0])["id"].split("-")[0])
        # The levels of the landing layout are no fields of its records.
        rows, batch_id = steps(batch.drop(*levels)), f"{number:014d}-{stream[0]}"
        if not keys:
            write_layer(rows, root, "silver", source, dataset, ts, batch_id)
            return
        # Kept while it is compared and written, so that the files are read once.
        rows = drop_duplicates(rows, keys, order_by).persist()
        try:
            fresh = rows
            if not snapshots.latest(session, ledger).version and exists(session, target):
                _start_ledger(rows, ledger, target, keys, batch_id)
            if snapshots.latest(session, ledger).version:
                fresh = new_rows(rows, known_keys(rows, ledger, keys, batch_id), keys)
            write_layer(fresh, root, "silver", source, dataset, ts, batch_id)
            store_keys(fresh, ledger, keys, batch_id)
        finally:
            rows.unpersist()

    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files)
    query = (
        reader.load(layer_path(root, "landing", source, dataset))
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return target

"""The whole deduplication; every intermediate result is a DataFrame of its own."""

from __future__ import annotations

import logging
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.quality import passes, passes_arrow, quality_filter
from ..functions.slices import checked_key, key, quality_key
from ..operators import shape
from ..operators.clusters import clusters, count_keys, first_records, survivors, taken
from ..operators.combine import counted_records
from ..operators.pairs import similarity_pairs
from ..options import DedupOptions
from ..runtime import checkpoint, stored
from ..sources.fastq import read_fastq, write_fastq

log = logging.getLogger("readcollapse")


class Deduplication:
    """reads -> kept -> keys -> pairs -> survivors -> output.  Nothing runs before a result is asked for.

    sequences and qualities: one Column for each mate.  order: what "first" means among the rows of a key.
    """

    def __init__(self, reads: DataFrame, sequences: list[Column], qualities: list[Column], order: Column, options: DedupOptions):
        self.reads, self.order, self.options = reads, order, options
        parts = list(options.slices) if options.slices is not None else None
        self.plain_key = key(sequences, parts)
        self.key = checked_key(self.plain_key)
        self.quality = quality_key(qualities, parts)
        self.observed = Observation("filter")

    @cached_property
    def kept(self) -> DataFrame:
        """Reads that pass the quality filter; only they are counted."""
        return quality_filter(self.reads, self.quality, self.options.max_error_rate, self.options.phred_offset, None if "counted" in self.__dict__ else self.observed)

    @cached_property
    def counted(self) -> DataFrame:
        """(seq, n, r): keys of all reads, how many of each were kept, and the first read of each: one pass where both are asked for."""
        o = self.options
        counts, judged = F.lit(True), None
        if o.filters:
            counts, judged = passes(self.quality, o.max_error_rate, o.phred_offset), (self.quality, passes_arrow(o.max_error_rate, o.phred_offset))
        rows = counted_records(self.reads, counts, self.plain_key, self.order, judged)
        if "kept" not in self.__dict__:  # which observes too, and an observation has one table
            total = F.coalesce(F.sum("m"), F.lit(0))
            rows = rows.observe(self.observed, total.alias("total"), (total - F.coalesce(F.sum("n"), F.lit(0))).alias("discarded"))
        # A key is checked once, not with every read that has it.
        return stored(rows.select(checked_key(F.col("seq")).alias("seq"), "n", "r"))

    @cached_property
    def keys(self) -> DataFrame:
        if "counted" in self.__dict__:
            return checkpoint(self.counted.filter("n > 0").select("seq", "n"))
        return checkpoint(count_keys(self.kept, self.key))

    @cached_property
    def pairs(self) -> DataFrame:
        return checkpoint(similarity_pairs(self.keys, self.options.max_distance, self.options.metric))

    @cached_property
    def clusters(self) -> DataFrame:
        return clusters(self.keys, self.pairs)

    @cached_property
    def survivors(self) -> DataFrame:
        return survivors(self.keys, self.pairs, self.options.method)

    @cached_property
    def output(self) -> DataFrame:
        """The first record of every survivor among all reads, those of low quality too."""
        if "keys" in self.__dict__ and "counted" not in self.__dict__:
            return first_records(self.reads, self.survivors, self.key, self.order)
        counted = self.counted  # before the keys, which then come of it
        return taken(counted, self.survivors, self.reads.columns)

    def report(self) -> str:
        return shape.report(self.keys)


def deduplicate(spark: SparkSession, options: DedupOptions) -> Deduplication:
    """A deduplication of the option's input files."""
    reads = read_fastq(spark, options.inputs)
    mates = range(len(options.inputs))
    at = lambda field: [F.col("mates")[i][field] for i in mates]
    return Deduplication(reads, at("sequence"), at("qualities"), F.struct("file_set", "rec_idx"), options)


def run(spark: SparkSession, options: DedupOptions) -> Deduplication:
    """Reads, deduplicates and writes; logs what it counts."""
    job = deduplicate(spark, options)
    job.counted  # noqa: B018  keys and first records in one pass
    distinct = job.keys.count()
    if options.filters:
        counts = job.observed.get
        log.info("%d records, %d discarded by quality", counts["total"], counts["discarded"])
    log.info("%d distinct keys", distinct)
    if log.isEnabledFor(logging.DEBUG):
        log.debug("%s", job.report())
        log.debug("%d clusters", job.clusters.select("cluster_id").distinct().count())
    job.survivors = checkpoint(job.survivors)
    log.info("%d distinct reads", job.survivors.count())
    write_fastq(job.output, options.outputs)
    return job

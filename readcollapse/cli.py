"""Command line: FASTQ files in, deduplicated FASTQ files out."""

from __future__ import annotations

import argparse
import logging
import resource
import time
from collections.abc import Sequence

from pyspark.sql import SparkSession

from . import options as o


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("readcollapse", description="Deduplicate reads by their keys and the keys' neighbours.")
    p.add_argument("fastq", nargs="+", metavar="FASTQ", help="input files, one for each mate")
    p.add_argument("-l", "--check-lengths", metavar="SLICES", help="what of each read is its key, e.g. 8 or 5:60,:-3; a part for each file (default: all)")
    p.add_argument("-o", "--output", action="append", metavar="FILE", help="output file; repeat it for each input")
    p.add_argument("-p", "--prefix", default=o.DEFAULT_PREFIX, help="prefix of output names if none are given (default: %(default)s)")
    p.add_argument("-d", "--max-distance", type=int, default=o.DEFAULT_DISTANCE, help="keys up to this distance are neighbours (default: %(default)s)")
    p.add_argument("-e", "--max-average-error-rate", type=float, default=o.DEFAULT_ERROR_RATE, help="reads above it are not counted (default: %(default)s)")
    p.add_argument("-E", "--no-average-error-rate-filter", dest="max_average_error_rate", action="store_const", const=1.0, help="count all reads")
    p.add_argument("--edit", action="store_true", help="Levenshtein instead of Hamming distance")
    p.add_argument("-c", "--cluster-dissection-method", choices=o.METHODS, default="directional", help="how representatives are chosen (default: %(default)s)")
    p.add_argument("-v", "--verbose", action="count", default=0)
    p.add_argument("-q", "--quiet", action="count", default=0)
    return p


def parsed(arguments: Sequence[str] | None = None) -> tuple[o.DedupOptions, int]:
    a = parser().parse_args(arguments)
    made = o.DedupOptions(
        slices=tuple(o.parse_slices(a.check_lengths)) if a.check_lengths else None,
        max_distance=a.max_distance,
        metric="levenshtein" if a.edit else "hamming",
        method=a.cluster_dissection_method,
        max_error_rate=a.max_average_error_rate,
        inputs=tuple(a.fastq),
        outputs=tuple(o.output_names(len(a.fastq), a.output, a.prefix)),
    )
    return made, logging.INFO - 10 * (a.verbose - a.quiet)


def main(arguments: Sequence[str] | None = None) -> None:
    from .plans.pipeline import run

    made, level = parsed(arguments)
    logging.basicConfig(format="%(asctime)s %(levelname)s %(message)s")
    log = logging.getLogger("readcollapse")
    log.setLevel(level)
    began = time.monotonic()
    run(SparkSession.builder.appName("readcollapse").getOrCreate(), made)
    # The driver's own; executors report theirs to Spark.
    log.info("finished in %.1f s, %.0f MiB of memory at most", time.monotonic() - began, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024)

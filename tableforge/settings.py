"""Session settings sized from the input and the cluster."""

from __future__ import annotations

_MB = 1024 * 1024


def recommended_conf(input_bytes: int, shuffle_bytes: int, total_cores: int) -> dict[str, str]:
    """Settings for a job that scans ``input_bytes`` and whose biggest shuffle is ``shuffle_bytes``.

    Scan tasks get 128-512 MB, about 64 of them per core on the largest inputs. Shuffle
    partitions start near 256 MB; AQE merges small neighbours at run time, so a generous
    estimate of ``shuffle_bytes`` costs little while a low one spills.
    """
    scan_bytes = min(512 * _MB, max(128 * _MB, input_bytes // (64 * total_cores)))
    partitions = max(total_cores, -(-shuffle_bytes // (256 * _MB)))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * _MB),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(scan_bytes),
        "spark.sql.session.timeZone": "UTC",
    }

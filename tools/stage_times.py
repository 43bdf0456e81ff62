"""Print the job/stage timeline of a Spark event log (no UI needed).

usage: python tools/stage_times.py <event-log-folder-or-file> [last_n_jobs]
Run a workload with spark.eventLog.enabled=true and spark.eventLog.dir set to
a scratch folder first (bench.py does so when BENCH_EVENT_LOG is set).
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys


def _lines(path: str):
    files = sorted(glob.glob(os.path.join(path, "*", "events*")) + glob.glob(
        os.path.join(path, "events*"))) if os.path.isdir(path) else [path]
    for f in files:
        if f.endswith((".zstd", ".zst")):
            import zstandard
            stream = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(open(f, "rb")))
        else:
            stream = open(f)
        yield from stream


def main() -> None:
    path = sys.argv[1]
    last = int(sys.argv[2]) if len(sys.argv) > 2 else 20
    stages, jobs = {}, {}
    for line in _lines(path):
        e = json.loads(line)
        ev = e["Event"]
        if ev == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            stages[si["Stage ID"]] = (si["Completion Time"] - si["Submission Time"],
                                      si["Number of Tasks"])
        elif ev == "SparkListenerJobStart":
            jobs[e["Job ID"]] = [e["Submission Time"], None, e["Stage IDs"]]
        elif ev == "SparkListenerJobEnd" and e["Job ID"] in jobs:
            jobs[e["Job ID"]][1] = e["Completion Time"]
    chosen = sorted(jobs.items())[-last:]
    if not chosen:
        return
    t0 = chosen[0][1][0]
    for jid, (start, end, sids) in chosen:
        parts = [f"stage {s}: {stages[s][0] / 1000:.2f}s/{stages[s][1]} tasks"
                 for s in sids if s in stages]
        print(f"job {jid} +{(start - t0) / 1000:.2f}s..+{((end or start) - t0) / 1000:.2f}s "
              + "; ".join(parts))


if __name__ == "__main__":
    main()

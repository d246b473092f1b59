"""Per-stage wall time of one registered query, from Spark's event log.

Usage: python tools/stage_times.py <query> [sf_dir] [runs]
The event log goes to a fresh scratch folder; the last run is summarised.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    name = sys.argv[1]
    sf = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.1"
    runs = int(sys.argv[3]) if len(sys.argv) > 3 else 2
    logdir = tempfile.mkdtemp(prefix="evlog-", dir="/tmp")
    from clickpath.plans import QUERIES
    from clickpath.session import build_session
    spark = build_session("local[8]", shuffle_partitions=16,
                          extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": logdir,
                                 "spark.eventLog.compress": "false"})
    for i in range(runs):
        spark.sparkContext.setJobGroup(f"run{i}", f"run{i}")
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    spark.stop()
    paths = [p for p in glob.glob(os.path.join(logdir, "**", "*"), recursive=True)
             if os.path.isfile(p) and not os.path.basename(p).startswith("appstatus")]
    lines = [ln for p in sorted(paths) for ln in open(p)]
    stages, jobs_of_last = {}, set()
    for line in lines:
        ev = json.loads(line)
        kind = ev.get("Event")
        if kind == "SparkListenerJobStart":
            props = ev.get("Properties", {})
            if props.get("spark.jobGroup.id") == f"run{runs - 1}":
                jobs_of_last.update(ev.get("Stage IDs", []))
        if kind == "SparkListenerStageCompleted":
            info = ev["Stage Info"]
            if "Completion Time" in info and "Submission Time" in info:
                stages[info["Stage ID"]] = (info["Completion Time"] - info["Submission Time"],
                                            info["Number of Tasks"], info["Stage Name"][:60])
    total = 0
    for sid in sorted(stages):
        if sid in jobs_of_last:
            ms, tasks, nm = stages[sid]
            total += ms
            print(f"stage {sid:4d} {ms:7d} ms {tasks:4d} tasks  {nm}")
    print("sum of stage times (ms):", total)


if __name__ == "__main__":
    main()

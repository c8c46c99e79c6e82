"""Compare two documents, or a folder of requests, from the command line.

``python -m arboris.cli SOURCE LOCALE --profile dita-map-v1 --locale fr-FR --out DIR``; paths are read by Spark, so any
file system that it knows will do. The exit code is 0, 1 (the comparison failed) or 2 (findings of the severity given).
"""

from __future__ import annotations

import argparse
import sys


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("--profile", default="generic-xml-v1")
    p.add_argument("--locale", default="und")
    p.add_argument("--out", help="folder for report.csv, report.json and report.html folders")
    p.add_argument("--fail-on", default="ERROR", choices=("INFO", "WARNING", "ERROR"))
    a = p.parse_args(args)

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from arboris.plans import jobs, report

    spark = SparkSession.builder.appName("arboris").getOrCreate()
    text = lambda path, name: spark.read.text(path, wholetext=True).select(F.col("value").alias(name))
    requests = text(a.source, "source_content").withColumn("k", F.lit(1)).join(text(a.target, "locale_content").withColumn("k", F.lit(1)), "k")  # one row each
    batch = jobs.compare(requests.select(F.lit("job").alias("pair_id"), F.lit(a.profile).alias("profile_id"), "source_content", "locale_content"), a.locale)
    state = batch.jobs.first()
    if state is None or state["state"] != "COMPLETED":
        print(f"{state['error_code']}: {state['error_message']}" if state else "INVALID_INPUT: nothing was read", file=sys.stderr)
        return 1
    loc = batch.by_profile[a.profile]
    rows = report.report_rows(loc)
    if a.out:
        report.write_csv(rows, f"{a.out}/report.csv")
        report.write_jobs(rows, f"{a.out}/report.json")
        report.html_pages(rows).select("html").write.mode("overwrite").text(f"{a.out}/report.html")
    for r in loc.status_counts.orderBy("status").collect():
        print(r["status"], r["n"])
    return jobs.exit_codes(batch.jobs, loc.findings, a.fail_on).first()["exit_code"]


if __name__ == "__main__":
    sys.exit(main())

"""Run registered queries against DuckDB: python tests/check_queries.py [folder] [name prefix ...]"""

from __future__ import annotations

import os
import sys
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from blotter.session import build_session
from tests.compare import compare, connect


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    import __spark_entry__ as entry

    spark = build_session("check", "local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql = connect(folder), entry.queries(), entry.oracle_sql()
    good = failed = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            problems, rows, seconds = compare(spark, con, name, fn, sql.get(name), folder)
        except Exception as error:
            text = traceback.format_exc() if os.environ.get("TRACE") else str(error)[:600]
            problems, rows, seconds = [f"{type(error).__name__}: {text}"], 0, 0.0
        if problems:
            failed += 1
        else:
            good += 1
        print(f"{'BAD ' if problems else 'ok  '} {name:40s} {rows:8d} rows {seconds:6.2f}s {'' if name in sql else '(rows only)'} {' | '.join(problems)}", flush=True)
    print(f"{good} good, {failed} bad")


if __name__ == "__main__":
    main()

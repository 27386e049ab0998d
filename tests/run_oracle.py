"""python tests/run_oracle.py FOLDER [name ...] - compare registered queries with their SQL."""

from __future__ import annotations

import pathlib
import sys
import time

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from compare import connect, difference  # noqa: E402

from voxtally.session import local_session  # noqa: E402


def main() -> int:
    import __spark_entry__ as entry

    folder, *wanted = sys.argv[1:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    runs, sql = entry.queries(), entry.oracle_sql()
    names = [n for n in runs if not wanted or any(n.startswith(w) for w in wanted)]
    failed = 0
    for name in names:
        start = time.time()
        try:
            if name in sql:
                problem = difference(runs[name](spark, folder), con, sql[name])
            else:
                problem = None if runs[name](spark, folder).count() else "empty"
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:700]}"
        failed += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {time.time() - start:6.2f}s {name} {'' if name in sql else '(rows only)'} {problem or ''}",
              flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())

"""The life of the tables in the shared folder: whose they are, and that nothing is left when the driver ends."""

import os
import subprocess
import sys
from pathlib import Path

from lodestrata import session as S

ROOT = str(Path(__file__).resolve().parent.parent)
SCRIPT = """
import sys
from pyspark.sql import SparkSession
from lodestrata.session import app_dir, cut, sweep
s = SparkSession.builder.master("local[1]").config("spark.checkpoint.dir", sys.argv[1]).config("spark.ui.enabled", "false").getOrCreate()
assert cut(s.range(5)).count() == 5
print("HELD", app_dir(s))
{extra}
"""


def held(folder, extra=""):
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(extra=extra), folder], capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ROOT}, check=False)
    return next(x.split()[1] for x in done.stdout.splitlines() if x.startswith("HELD")), done


def files(folder):
    return [f for _, _, fs in os.walk(folder) for f in fs if not f.startswith(".")]


def test_nothing_is_left_and_others_tables_stay(tmp_path):
    other = tmp_path / "lodestrata" / "other-application"
    other.mkdir(parents=True)
    (other / "part-0").write_text("x")
    at, done = held(str(tmp_path), "sweep(s)")  # a path without a scheme; sweep and the end of the driver leave the other's alone
    assert done.returncode == 0 and at.startswith(str(tmp_path)) and files(tmp_path) == ["part-0"]
    at, _ = held(str(tmp_path), "s.stop()")
    assert files(tmp_path) == ["part-0"] and not os.path.exists(at)
    at, done = held(str(tmp_path), "raise ValueError")
    assert done.returncode == 1 and files(tmp_path) == ["part-0"]
    at, _ = held(str(tmp_path), "import os; os._exit(3)")  # Python's own clean-up does not run; the JVM's does
    for _ in range(100):
        if not files(at):
            break
        import time

        time.sleep(0.2)
    assert files(tmp_path) == ["part-0"]


def test_scoped_functions_drop_what_they_wrote(spark):
    kept = []

    @S.scoped
    def inner(n):
        kept.append(S.cut(spark.range(n)))
        return S.cut(kept[-1].where("id > 0"))

    @S.scoped
    def lazy(n):
        return inner(n).where("id > 1")

    @S.scoped
    def outer(n):
        return S.cut(lazy(n))

    path = lambda df: df._lodestrata_path.removeprefix("file://")
    got = outer(5)
    assert got.count() == 3 and os.path.isdir(path(got)) and not os.path.exists(path(kept[0])) and S.rows(got) == 3


def test_scopes_are_of_one_thread(spark):
    from threading import Event, Thread

    inside, done, made = Event(), Event(), []

    @S.scoped
    def slow():
        inside.set()
        done.wait(60)
        return S.cut(spark.range(1))

    t = Thread(target=slow)
    t.start()
    inside.wait(60)
    made.append(S.cut(spark.range(7)))
    done.set()
    t.join()
    assert made[0].count() == 7


def test_identity(spark):
    r = S.runtime_identity(spark).first()
    assert r["spark"] == spark.version and r["place"].endswith("lodestrata")

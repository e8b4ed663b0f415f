import subprocess
import sys

from tests.conftest import ROOT

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from laneflow.session import build_session
from laneflow.llm import ann, conversations, language, neardup, quality
spark = build_session("elsewhere", "local[2]", spark__ui__enabled="false", spark__sql__shuffle__partitions="2")
docs = spark.createDataFrame([(i, "one two three four five " + "abc xyz "[i % 2 * 4:][:4] * 3, ["en", "xx"][i % 2]) for i in range(12)], "doc_id long, text string, lang string")
labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
assert language.identify(docs, language.learn(docs)).count() == 12
assert quality.classify(docs, quality.learn(docs, labels)).count() == 12
assert neardup.near_duplicates(docs).count() == 12
assert conversations.plan(spark.createDataFrame([(1, 1, "user", "x.")], "conv_id long, turn long, role string, text string")).count() == 1
assert ann.search(spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>")).count() == 1
print("fine")
"""


def test_operators_run_from_another_folder(tmp_path):
    """Executors find the package though neither the working folder nor PYTHONPATH leads to it."""
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=280)
    assert done.returncode == 0 and "fine" in done.stdout, done.stderr[-3000:]

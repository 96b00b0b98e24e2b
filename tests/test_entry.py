"""The entry works with and without the subpackage of training-data operators."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = ("import sys; sys.path.insert(0, {root!r}); import __spark_entry__ as e; "
         "print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries(), sum(n.startswith('op') for n in e.queries()))")


def _counts(root):
    out = subprocess.run([sys.executable, "-c", COUNT.format(root=root)], capture_output=True, text=True, timeout=120, cwd="/")
    assert out.returncode == 0, out.stderr
    n, oracles, pipeline, ops = out.stdout.split()
    return int(n), int(oracles), pipeline == "True", int(ops)


def _linked(tmp_path, without):
    """A copy of the repository, as links, without some of its parts."""
    skip = {os.path.join(ROOT, w) for w in without}
    for name in os.listdir(ROOT):
        if name.startswith(".") or os.path.join(ROOT, name) in skip:
            continue
        if name == "shelfcast":
            os.makedirs(tmp_path / name)
            for inner in os.listdir(os.path.join(ROOT, name)):
                if os.path.join(ROOT, name, inner) not in skip:
                    os.symlink(os.path.join(ROOT, name, inner), tmp_path / name / inner)
        elif name.endswith(".py"):
            (tmp_path / name).write_text(open(os.path.join(ROOT, name), encoding="utf-8").read(), encoding="utf-8")
    return str(tmp_path)


def test_entry_without_the_subpackage(tmp_path):
    """With corpus_pipeline.py left over, as when only the folders are gone."""
    n, oracles, pipeline, ops = _counts(_linked(tmp_path, ["shelfcast/llm"]))
    assert n > 80 and oracles > 60 and not pipeline and ops == 0


def test_entry_without_the_subpackage_and_the_pipeline(tmp_path):
    assert _counts(_linked(tmp_path, ["shelfcast/llm", "corpus_pipeline.py"]))[2:] == (False, 0)

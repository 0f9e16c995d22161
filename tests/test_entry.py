"""The driver contract stands without the training-data operators or a package that they need."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
HIDE = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name.split('.')[0] == {name!r} or name == {name!r}:
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as entry
print(len(entry.queries()), len(entry.oracle_sql()), sum(n.startswith('op') and n[2].isdigit() for n in entry.queries()))
"""


def counts(name):
    out = subprocess.run([sys.executable, "-c", HIDE.format(name=name)], cwd=ROOT, capture_output=True, text=True, check=True)
    return [int(n) for n in out.stdout.split()[-3:]]


def test_a_hidden_package_hides_its_operators_only():
    every = counts("no_such_package")
    for name in ("xxhash", "tabkit.llm", "corpus_pipeline", "public_tokenizers"):
        rest = counts(name)
        assert rest[0] >= 149 and rest[2] == 0 and rest[1] > 120
    assert every[0] >= rest[0]

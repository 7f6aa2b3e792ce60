import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from textlode.session import local_session
    s = local_session(4, partitions=4, memory="6g")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


C_FILE = """/* util */
#define MAX(a,b) x
static int counter = 0;
// Insert a tuple into the heap page
int heap_insert(int a, char *b) {
  helper(a);
  if (a) { obj->put(b); return other_fn("x(y)"); }
}

void helper(int z)
{
  heap_insert(z, 0);
  helper(z);
}
struct Foo { int q; };
"""
PY_FILE = """import x
class Foo:
    def bar(self, a):
        return baz(a)
    # Computes the base value
    def baz(self, q):
        return q
LIMIT = 3
"""


@pytest.fixture(scope="session")
def code(spark):
    rows = [("src/heap/heapam.c", C_FILE, "c", 1), ("src/py/foo.py", PY_FILE, "python", 2), ("notes.md", "x heap(", "markdown", 3)]
    return spark.createDataFrame(rows, "path string, content string, language string, ord long")

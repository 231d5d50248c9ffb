import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lakesearch.session import local_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", memory="6g", app="tests")
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture
def tree(tmp_path):
    """A small source tree with the known traps of a scan."""
    files = {
        "main.py": b"def main():\r\n    return 1\r\n",
        "util.go": b"package a\n\nfunc Util() int { return 1 }\n",
        "notes.md": b"# notes\n",
        "up.PY": b"x = 1\n",
        "node_modules/lib.js": b"function lib() { }\n",
        ".git/config.py": b"x = 1\n",
        "build/gen.py": b"x = 1\n",
        "pkg.egg-info/x.py": b"x = 1\n",
        "src/app.js": b"function app() { return 1 }\n",
        "src/bad.py": b"\x80\x81\x82\xff\xfe",
        "src/surrogate.py": b"x = '\xed\xa0\x80'",
        "src/_private/__init__.py": b"",
        ".hidden.py": b"x = 1\n",
        "a/b.py": b"y = 2\n",
        "a-b.py": b"z = 3\n",
    }
    for name, content in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return str(tmp_path)

"""Manifests, and downloads from a server of our own."""

import hashlib
import http.server
import threading
from functools import partial

import pytest

from tidemark.sources import assets


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


@pytest.fixture
def server(tmp_path):
    (tmp_path / "remote").mkdir()
    for name in ("a.bin", "b.bin", "wrong.bin"):
        (tmp_path / "remote" / name).write_bytes(name.encode() * 1000)

    class Quiet(http.server.SimpleHTTPRequestHandler):
        def log_message(self, *args):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), partial(Quiet, directory=str(tmp_path / "remote")))
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_fetches_what_is_missing_and_verifies_it(spark, tmp_path, server):
    root = tmp_path / "local"
    (root / "x").mkdir(parents=True)
    (root / "x/a.bin").write_bytes(b"a.bin" * 1000)
    pinned = [{"path": f"x/{n}", "sha256": " " + sha((n if n[0] != "w" else "other").encode() * 1000).upper()} for n in ("a.bin", "b.bin", "wrong.bin", "none.bin")]
    m = assets.parse({"release": server, "assets": pinned})
    pins = assets.pins(spark, m)
    due = assets.due(pins, assets.on_disk(spark, f"file://{root}"), m.release)
    got = {p: (n, e) for p, n, e in assets.fetch(due, root)}
    assert got["x/b.bin"] == (5000, None) and got["x/none.bin"] == (None, "HTTP 404") and got["x/wrong.bin"][1].startswith("checksum mismatch") and len(got) == 3
    assert sorted(p.name for p in (root / "x").iterdir()) == ["a.bin", "b.bin"]
    assert assets.due(pins, assets.on_disk(spark, f"file://{root}"), m.release).count() == 2
    assert assets.due(pins, assets.on_disk(spark, f"file://{root}"), m.release, force=True).count() == 4
    assert [r["path"] for r in assets.matching(pins, "b*").collect()] == ["x/b.bin"]


def test_urls(spark):
    one = assets.pins(spark, assets.parse({"release": "https://h/", "assets": [{"path": "d/f.x", "sha256": "0" * 64}]}))
    assert one.select(assets.url("https://h/v1/", one["name"])).first()[0] == "https://h/v1/f.x"
    assert one.select(assets.url("https://h/{name}?x", one["name"])).first()[0] == "https://h/f.x?x"
    with pytest.raises(assets.FetchError, match="only http"):
        assets.download("file:///etc/hosts", __import__("pathlib").Path("/tmp/none"), "0" * 64)


@pytest.mark.parametrize("bad", [
    [], {"assets": []}, {"release": "r", "more": 1}, {"release": "r", "timeout": 0}, {"release": "r", "assets": [{"path": "/x", "sha256": "0" * 64}]},
    {"release": "r", "assets": [{"path": "../x", "sha256": "0" * 64}]}, {"release": "r", "assets": [{"path": "x", "sha256": 1}]},
    {"release": "r", "assets": [{"path": p, "sha256": "0" * 64} for p in ("a/x", "b/x")]},
])
def test_bad_manifests(bad):
    with pytest.raises(assets.ManifestError):
        assets.parse(bad)


def test_missing_manifest(tmp_path):
    with pytest.raises(assets.ManifestError, match="no manifest"):
        assets.load(tmp_path / "m.yaml")
    (tmp_path / "m.yaml").write_text("a: [")
    with pytest.raises(assets.ManifestError, match="not YAML"):
        assets.load(tmp_path / "m.yaml")

import hashlib
import os

from spendlens.sources import files


def _want(data: bytes, step: int = 1000) -> str:
    return hashlib.sha256(b"".join(hashlib.sha256(data[i : i + step]).digest() for i in range(0, len(data), step))).hexdigest()


def test_chunked_digest_any_split(spark, folder):
    blobs = {"a.bin": os.urandom(12_345), "b.bin": os.urandom(1000), "c.bin": b"", "d.bin": os.urandom(999)}
    for name, data in blobs.items():
        with open(os.path.join(folder, name), "wb") as f:
            f.write(data)
    for per_task in (1, 3, 100):
        got = {os.path.basename(r.path): (r.sha256, r.length, r.chunks)
               for r in files.chunked_checksums(spark, folder, "*.bin", per_task, 1000).collect()}
        assert got == {n: (_want(d), len(d), -(-len(d) // 1000)) for n, d in blobs.items() if d}  # empty: not listed


def test_chunked_digest_of_no_files(spark, folder):
    os.makedirs(os.path.join(folder, "none"))
    with open(os.path.join(folder, "none", "x.txt"), "w") as f:
        f.write("x")
    assert files.chunked_checksums(spark, os.path.join(folder, "none"), "*.bin").count() == 0

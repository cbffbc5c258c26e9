import zlib

import numpy as np
from pyarrow import fs

from stratalane.llm import token_files
from stratalane.session import load
from tests.llm.test_packing import ids_of


def test_round_trip(spark, odd_docs, no_docs):
    for docs in (load(spark, "/root/testdata/sf0.001", "documents"), odd_docs):
        manifest = token_files.write_tokens(docs, length=128)
        rows = token_files.read_documents(manifest).collect()
        order = sorted(rows, key=lambda r: r.start)
        assert [r.doc_id for r in order] == sorted((r.doc_id for r in order), key=lambda x: (x is not None, x))
        texts = {}
        for r in docs.collect():
            texts.setdefault(r.doc_id, set()).add(r.text)
        at = 0
        for r in order:
            assert r.start == at
            at += r.n_tokens
            wanted = [ids_of(t, 1) for t in texts[r.doc_id]]
            assert (r.n_tokens, r.ids_crc32) in [(len(x), zlib.crc32(x.tobytes())) for x in wanted]
        assert len(rows) == docs.count()
    assert token_files.round_trip(no_docs).collect() == []


def test_random_access_is_zero_copy(tmp_path):
    path = str(tmp_path / "x.ids")
    ids = np.arange(1000, dtype=np.uint32)
    with fs.LocalFileSystem().open_output_stream(path) as sink:
        out = token_files.SequenceWriter(sink, length=16, batch=4)
        for at in range(0, 1000, 37):
            out.write(ids[at : at + 37])
        out.close()
    held = token_files.SequenceFile(f"file://{path}", batch=4)
    for k in (0, 5, 61, 62):
        got, mask = held.sequence(k)
        real = ids[16 * k : 16 * k + 16]
        assert (got[: len(real)] == real).all() and mask.true_count == len(real) and not got.flags.owndata
    for start, n in ((0, 1000), (3, 0), (15, 200), (999, 1)):
        assert (held.tokens(start, n) == ids[start : start + n]).all()
    held.close()


def test_lost_attempts_do_no_harm(spark, odd_docs):
    """Files that no manifest names, as a lost or doubled task leaves them, are never read."""
    folder = token_files.fresh_path(spark, "tokens")
    token_files.write_tokens(odd_docs, folder)
    second = token_files.write_tokens(odd_docs, folder)
    assert token_files.read_documents(second).count() == odd_docs.count()


def test_rows_of_one_doc_id_have_one_order(spark):
    rows = [(1, "one two"), (1, "one"), (None, "three"), (1, "two"), (1, "one"), (0, None)] * 3
    found = [token_files.round_trip(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).collect() for n in (1, 5)]
    first, second = ([tuple(r) for r in sorted(x, key=lambda r: r.start)] for x in found)
    assert first == second and [r[0] for r in first] == [None] * 3 + [0] * 3 + [1] * 12

"""Operators 3 and 5 against the tokenizer libraries."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.orc as orc
import pytest
import tiktoken
from tokenizers import Tokenizer

from fleetscope.llm import byte_bpe, token_orc
from fleetscope.llm.common import shared_folder
from fleetscope.llm.pretokens import PATTERN, load_ranks, segments

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def coder():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(RANKS), special_tokens={})


def odd_texts(count, seed):
    draw = random.Random(seed)
    letters = list("ab'st !?1é\n\t　\x85\x1c\xa0中٣²ǅ<|>") + [" "] * 6 + ["<|endoftext|>", "\U0001f600", " foo", "'ll"]
    return ["".join(draw.choice(letters) for _ in range(draw.randint(0, 25))) for _ in range(count)]


def test_pattern_is_the_public_one():
    assert PATTERN == public_tokenizers.PATTERN


def test_segments_can_be_encoded_alone(coder):
    for text in odd_texts(5000, 1):
        pieces = segments(text)
        assert "".join(pieces) == text
        assert [one for piece in pieces for one in coder.encode_ordinary(piece)] == coder.encode_ordinary(text)


def test_segment_coder_like_the_library():
    code, library = token_orc.SegmentCoder(FILE, most=50), Tokenizer.from_file(FILE)
    assert code.plain
    for text in odd_texts(3000, 2):
        assert np.frombuffer(code(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize(("buckets", "most"), [(1, 24_000_000), (5, 200)])
def test_bpe_round_trip(spark, edge_rows, edge_docs, coder, buckets, most):
    odd = [(1000 + at, text) for at, text in enumerate(odd_texts(300, 3))]
    docs = edge_docs.select("doc_id", "text", "key", "n").unionByName(spark.createDataFrame([(*row, 1, 1) for row in odd], "doc_id long, text string, key long, n long"))
    encoded = byte_bpe.encode(docs, RANKS, PATTERN, buckets, most, on_disk=False)
    got = byte_bpe.decode(encoded, RANKS).collect()
    want = Counter((doc_id, tuple(coder.encode_ordinary(text or "")), (text or "").encode()) for doc_id, text in edge_rows + odd)
    assert Counter((row.doc_id, tuple(np.frombuffer(row.ids, "<u4").tolist()), bytes(row.decoded)) for row in got) == want
    assert all(row.n_tokens * 4 == len(row.ids) for row in got)


def test_bpe_of_no_rows(spark, no_docs):
    assert byte_bpe.decode(byte_bpe.encode(no_docs, RANKS, PATTERN), RANKS).count() == 0


def test_orc_index(spark, edge_rows, edge_docs):
    folder = shared_folder(spark, "tokens")
    token_orc.write_tokens(edge_docs, folder, FILE, parts=3)
    got = token_orc.token_index(token_orc.read_tokens(spark, folder)).collect()
    library, start, want = Tokenizer.from_file(FILE), 0, []
    rows = [(doc_id, [*library.encode(text or "", add_special_tokens=False).ids, 2]) for doc_id, text in edge_rows]
    for doc_id, ids in sorted(rows, key=lambda row: (row[0] is not None, row[0] or 0, len(row[1]))):
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    missing = [row for row in want if row[0] is None]
    assert sorted(tuple(row) for row in got if row.doc_id is not None) == sorted(row for row in want if row[0] is not None)
    assert sorted(row.n_tokens for row in got if row.doc_id is None) == sorted(row[2] for row in missing)


def test_orc_files_are_sorted_and_carry_metadata(spark, edge_docs):
    folder = shared_folder(spark, "tokens")
    token_orc.write_tokens(edge_docs, folder, FILE, parts=2)
    from pathlib import Path
    from urllib.parse import urlparse

    files = sorted(Path(urlparse(folder).path).glob("*.orc"))
    ids = [[one for one in orc.ORCFile(file).read(["doc_id"]).column("doc_id").to_pylist() if one is not None] for file in files]
    assert all(one == sorted(one) for one in ids) and sum(ids, []) == sorted(sum(ids, []))
    assert all(orc.ORCFile(file).row_index_stride == 1000 for file in files if orc.ORCFile(file).nrows)
    assert spark.read.orc(folder).where("doc_id = 101").count() == 1


@pytest.fixture(scope="module")
def orc_reader(spark):
    """The ORC library's own reader of one written file, and the first of the even ids that the file holds."""
    first = 1 << 40
    docs = spark.range(20_000).selectExpr(f"{first} + 2 * id AS doc_id", "concat('text ', id % 7) AS text")
    folder = shared_folder(spark, "tokens")
    token_orc.write_tokens(docs, folder, FILE, parts=1)
    java = spark._jvm
    path = java.org.apache.hadoop.fs.Path(folder)
    settings = spark._jsc.hadoopConfiguration()
    (file,) = [one.getPath() for one in path.getFileSystem(settings).listStatus(path) if one.getPath().getName().endswith(".orc")]
    return java.org.apache.orc.OrcFile.createReader(file, java.org.apache.orc.OrcFile.readerOptions(settings)), first


def test_orc_integers_are_run_length_encoded(orc_reader):
    reader, _ = orc_reader
    footer = reader.rows().readStripeFooter(reader.getStripes()[0])
    kinds = {name: footer.getColumns(reader.getSchema().findSubtype(name).getId()).getKind().toString() for name in ("part", "doc_id", "ids._elem")}
    assert set(kinds.values()) == {"DIRECT_V2"}
    # 20,000 ids in steps of 2 are a handful of runs: without them they would take 8 bytes each.
    number = reader.getSchema().findSubtype("doc_id").getId()
    data = [one.getLength() for one in footer.getStreamsList() if one.getColumn() == number and one.getKind().toString() == "DATA"]
    assert sum(data) < 20_000


def test_orc_metadata_prunes_stripes_and_row_groups(spark, orc_reader):
    reader, first = orc_reader
    java = spark._jvm.org.apache.hadoop.hive.ql.io.sarg
    number = reader.getSchema().findSubtype("doc_id").getId()
    footer = reader.rows().readStripeFooter(reader.getStripes()[0])
    kinds = {one.getKind().toString() for one in footer.getStreamsList() if one.getColumn() == number}
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds

    def rows_read(doc_id):
        wanted = java.SearchArgumentFactory.newBuilder().startAnd().equals("doc_id", getattr(java, "PredicateLeaf$Type").LONG, doc_id).end().build()
        rows = reader.rows(reader.options().searchArgument(wanted, spark.sparkContext._gateway.new_array(spark._jvm.java.lang.String, 0)))
        batch, read = reader.getSchema().createRowBatch(), 0
        while rows.nextBatch(batch):
            read += batch.count()
        return read

    assert rows_read(first + 2 * 7_000) == 1000  # one row group by the row index
    assert rows_read(first - 10) == 0  # outside of every stripe
    # Odd ids lie inside the ranges of the row groups: only the Bloom filter tells that they are not there.
    assert sum(rows_read(first + 2 * at + 1) for at in range(0, 20_000, 500)) <= 3000


def test_orc_of_no_rows(spark, no_docs):
    folder = shared_folder(spark, "tokens")
    token_orc.write_tokens(no_docs, folder, FILE, parts=2)
    assert token_orc.token_index(token_orc.read_tokens(spark, folder)).count() == 0

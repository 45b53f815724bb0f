import shutil

import pytest
from codeweave import queries


@pytest.mark.parametrize("folder", [False, True])
def test_stream_reads_a_file_and_a_folder_of_files(spark, tmp_path, folder):
    one = "/root/testdata/sf0.001/documents.parquet"
    if folder:
        spark.read.parquet(one).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    else:
        shutil.copy(one, tmp_path / "documents.parquet")
    got = queries.i6_incremental_stream(spark, str(tmp_path))
    assert got.count() == spark.read.parquet(one).where("octet_length(text) <= 1048576").count() > 0

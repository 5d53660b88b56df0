"""Session helpers: scratch, and the cache's key."""
import os
import shutil
import tempfile

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_changed_input_is_another_key(spark):
    from tillstar.plans.star import session_key
    d = tempfile.mkdtemp(prefix="tillstar-in-")
    shutil.copy(f"{SF}/region.parquet", d)
    first = session_key(spark, d)
    assert first == session_key(spark, d)
    shutil.copy(f"{SF}/nation.parquet", d)
    assert session_key(spark, d) != first


def test_scratch_is_below_the_checkpoint_folder(spark):
    from tillstar.session import checkpoint_dir, materialize, scratch_path
    assert scratch_path(spark, "x").startswith(os.path.join(checkpoint_dir(spark), "tillstar"))
    df = materialize(spark.range(3), "t")
    assert df.count() == 3
    plain = lambda p: "/" + p.removeprefix("file:").lstrip("/")
    assert all(plain(f).startswith(plain(checkpoint_dir(spark))) for f in df.inputFiles())

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from gleaner.functions import hashing


def test_one_digest_for_one_content():
    a = hashing.digest('{"title": " a  b ", "salary": "{\\"min\\": 1, \\"per\\": [{\\"y\\": 1.0, \\"x\\": \\"\\"}]}"}', ("salary",))
    b = hashing.digest('{"salary": {"per": [{"x": null, "y": 1.0}], "min": 1}, "title": "a b"}')
    assert a == b == hashlib.sha256(b'{"salary":{"min":1,"per":[{"x":null,"y":1.0}]},"title":"a b"}').hexdigest()
    different = ['{"title": "a b"}', '{"title": "A b"}', '{"title": null}', '{"salary": "1"}', '{"salary": 1}', '{"salary": 1.0}', '{"salary": [1]}', '{"salary": true}', '{"salary": "{broken"}']
    assert len({hashing.digest(x, ("salary",)) for x in different}) == len(different)


def test_columns(spark):
    df = spark.createDataFrame([("t", "{\"b\":1,\"a\":[]}", True), (None, None, None)], "t string, s string, r boolean")
    got = [r.d for r in df.select(hashing.content_digest(title=F.col("t"), salary=F.col("s"), remote=F.col("r")).alias("d")).collect()]
    want = [dict.fromkeys(hashing.CONTENT) | x for x in ({"title": "t", "salary": {"a": [], "b": 1}, "remote": True}, {})]
    assert got == [hashlib.sha256(json.dumps(w, sort_keys=True, separators=(",", ":")).encode()).hexdigest() for w in want]
    with pytest.raises(ValueError):
        hashing.content_digest(colour=F.lit("x"))

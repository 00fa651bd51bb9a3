"""Numbers of payloads are read as arrays, with the results of the general expressions."""

import numpy as np

from threadlake.functions import records as R
from threadlake.operators import content as C


def test_numbers_to_bytes():
    assert C._number_text(np.array([1.9, -1.0, np.nan, 1e300, 2.0**63, -(2.0**63), 256.0]), None) == bytes([1, 255, 0, 0, 255, 0, 0])
    assert C._number_text(np.array([3.0, 1.0, 2.0]), np.array(["10", "0", "9"], dtype=object)) == bytes([1, 2, 3])
    assert C._number_text(np.array([3.0, 1.0]), np.array(["1", "01"], dtype=object)) is None


def test_every_form(spark):
    texts = ['"data:image/png;base64,QUJD"', '"QUJDRA"', '"QUJDR"', "[65,66.9,null,-1,true]", '[65,"x",66]', "[]", '{"1":66,"0":65,"x":1}', '{"1":66,"01":65}',
             '{"encoded":"QUJDREVG","byteOffset":2,"length":3}', "12", "null", '{"x":1}', None]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, j string")
    got = [None if r["b"] is None else bytes(r["b"]) for r in rows.select("n", C.decode_payload(R.parse("j")).alias("b")).orderBy("n").collect()]
    assert got == [b"ABC", b"ABCD", b"ABC", bytes([65, 66, 0, 255, 1]), bytes([65, 0, 66]), b"", b"AB", b"AB", b"CDE", None, None, None, None]

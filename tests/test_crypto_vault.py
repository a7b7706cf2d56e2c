import pytest
from pyspark.sql import functions as F

from caseflow.functions import crypto as K
from caseflow.operators.cases import current_vault
from caseflow.sources import vault as V

KEY, OTHER = "0f" * 32, "a5" * 32
VAULT = "case_id string, ingest_seq bigint, mappings array<struct<token:string,original:string>>"


@pytest.fixture(scope="module")
def keys(spark):
    return K.key_table(spark, team=KEY, other=OTHER)


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "t string")


@pytest.mark.parametrize("encrypt, decrypt", [(K.encrypt, K.decrypt), (K.encrypt, K.try_decrypt),
                                              (K.encrypt_cbc, K.decrypt_cbc)])
def test_round_trip(spark, keys, encrypt, decrypt):
    key = K.key_column(keys, "team")
    sealed = texts(spark, "Hello, secret world!", "é中", "x" * 5000).select("t", encrypt(F.col("t"), key).alias("p"))
    assert sealed.select(decrypt(F.col("p"), key).alias("back"), "t").filter("back <=> t").count() == 3


def test_form_and_random_iv(spark, keys):
    key = K.key_column(keys, "team")
    rows = texts(spark, "same text", "same text").select(K.encrypt(F.col("t"), key).alias("p")).collect()
    assert rows[0].p != rows[1].p
    iv, tag, body = rows[0].p.split(":")
    assert (len(iv), len(tag), len(body)) == (24, 32, 18)


def test_wrong_key_and_malformed_payload(spark, keys):
    sealed = texts(spark, "secret").select(K.encrypt(F.col("t"), K.key_column(keys, "team")).alias("p")).cache()
    sealed.count()
    other = K.key_column(keys, "other")
    assert sealed.select(K.try_decrypt(F.col("p"), other).alias("t")).first().t is None
    with pytest.raises(Exception):
        sealed.select(K.decrypt(F.col("p"), other).alias("t")).collect()
    with pytest.raises(Exception, match="invalid ciphertext format"):
        texts(spark, "bad:data").select(K.decrypt(F.col("t"), other).alias("t")).collect()
    assert texts(spark, "bad:data").select(K.try_decrypt(F.col("t"), other).alias("t")).first().t is None
    assert texts(spark, "bad:data").select(K.decrypt_cbc(F.col("t"), other).alias("t")).first().t == "{}"


def test_the_key_is_in_no_plan(spark, keys):
    df = texts(spark, "x").select(K.encrypt(F.col("t"), K.key_column(keys, "team")).alias("p"))
    plan = df._jdf.queryExecution().toString() + df._jdf.queryExecution().executedPlan().toString()
    assert "0f0f0f" not in plan.lower() and "15, 15, 15" not in plan


def test_key_length_is_checked(spark):
    with pytest.raises(ValueError):
        K.key_table(spark, short="00")


def test_vault_write_read_and_damage(spark, keys, tmp_path):
    rows = spark.createDataFrame([("a", 1, [("[IP_1]", "1.1.1.1")]), ("b", 2, [("[IP_1]", "2.2.2.2")])], VAULT)
    path = str(tmp_path / "vault")
    V.write_vault(rows, path, keys, "team")
    back = V.read_vault(spark, path, keys)
    assert {(r.case_id, r.mappings[0].original) for r in back.collect()} == {("a", "1.1.1.1"), ("b", "2.2.2.2")}
    assert V.unreadable_count(back) == 0
    stored = spark.read.parquet(path)
    assert stored.filter(F.col("payload").contains("1.1.1.1")).count() == 0
    unknown = V.read_vault(spark, path, keys.filter("key_id = 'other'"))
    assert V.unreadable_count(unknown) == 2


def test_transfer_and_merge(spark, keys, tmp_path):
    own = V.seal(spark.createDataFrame([("a", 1, [("[IP_1]", "1.1.1.1")])], VAULT), keys, "team")
    theirs = V.seal(spark.createDataFrame([("a", 5, [("[IP_1]", "5.5.5.5")])], VAULT), keys, "other")
    moved = V.transfer(theirs, keys, "team")
    assert {r.key_id for r in moved.collect()} == {"team"}
    last = current_vault(V.unseal(V.merge(own, moved), keys)).collect()
    assert [(r.case_id, r.mappings[0].original) for r in last] == [("a", "5.5.5.5")]
    with pytest.raises(Exception, match="cannot decrypt"):
        V.transfer(theirs, keys.filter("key_id = 'team'").unionByName(K.key_table(spark, other=KEY)), "team").collect()


def test_a_payload_belongs_to_its_row(spark, keys):
    rows = [("a", 1, [("[IP_1]", "1.1.1.1")]), ("b", 1, [("[IP_1]", "2.2.2.2")]), ("a", 2, [("[IP_1]", "3.3.3.3")]), ("a", None, [])]
    sealed = V.seal(spark.createDataFrame(rows, VAULT), keys, "team").cache()
    assert V.unseal(sealed, keys).filter("readable").count() == 4
    payload = {(r.case_id, r.ingest_seq): r.payload for r in sealed.collect()}
    turned = {("a", 1): ("b", 1), ("b", 1): ("a", 1), ("a", 2): ("a", 1), ("a", None): ("a", 2)}
    moved = spark.createDataFrame([(c, n, "team", payload[turned[c, n]]) for c, n in payload], sealed.schema)
    assert V.unseal(moved, keys).filter("readable").count() == 0 and V.unreadable_count(V.unseal(moved, keys)) == 4


def test_keys_are_rotated_along_their_chain(spark, keys):
    first = V.seal(spark.createDataFrame([("a", 1, [("[IP_1]", "1.1.1.1")])], VAULT), keys, "team")
    second = V.seal(spark.createDataFrame([("b", 2, [("[IP_1]", "2.2.2.2")])], VAULT), keys, "other")
    rotated = V.rotate(first.unionByName(second), keys, ["team", "other"]).cache()
    assert {r.key_id for r in rotated.collect()} == {"other"}
    opened = V.unseal(rotated, keys.filter("key_id = 'other'")).collect()
    assert sorted((r.case_id, r.mappings[0].original) for r in opened) == [("a", "1.1.1.1"), ("b", "2.2.2.2")]
    assert {r.key_id for r in V.rotate(first, keys, ["other"]).collect()} == {"team"}

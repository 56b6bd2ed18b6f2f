"""The significance fit takes every token with enough evidence, whatever its share of the documents."""

from codepend import registry


def test_rarer_tokens_are_fitted(spark, tmp_path):
    # 1,000 documents; each of the 6 rare tokens stands in 160 to 200 of them, far below three tenths
    rows = [(i, " ".join(["every", *(f"rare{chr(97 + k)}" for k in range(6) if (i * (2 * k + 3)) % 1009 < 160 + 8 * k), *(["few"] if i < 90 else [])]), "en") for i in range(1000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    genes = {r["gene"] for r in registry.queries()["p01_null_fits"](spark, str(tmp_path)).collect()}
    assert {f"rare{c}" for c in "abcdef"} <= genes and "few" not in genes

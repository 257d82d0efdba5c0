"""Readers and writers on small files."""

from pyspark.sql import functions as F

from trialspark.sources import text as TX


def test_read_delimited_na_and_nan(spark, tmp_path):
    p = tmp_path / "pheno.tsv"
    p.write_text("Hybrid\tYear\tYield_Mg_ha\nH1\t2020\t5.5\nH2\tNA\tNA\nH3\t2021\tNaN\n")
    df = TX.read_delimited(spark, str(p), "Hybrid string, Year int, Yield_Mg_ha double")
    got = [tuple(r) for r in df.orderBy("Hybrid").collect()]
    assert got == [("H1", 2020, 5.5), ("H2", None, None), ("H3", 2021, None)]


def test_tab_sink_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("H1", 1.5), ("H2", None)], "Hybrid string, y double")
    out = str(tmp_path / "out")
    TX.write_delimited(df, out)
    text = "".join(open(f).read() for f in sorted((tmp_path / "out").glob("part-*")))
    assert "NA" in text and '"' not in text
    back = TX.read_delimited(spark, out, df.schema)
    assert sorted(tuple(r) for r in back.collect()) == [("H1", 1.5), ("H2", None)]


def test_csv_sink_has_header(spark, tmp_path):
    df = spark.createDataFrame([("E", "H", 1.0)], "Env string, Hybrid string, Yield_Mg_ha double")
    out = tmp_path / "pred"
    TX.write_csv(df.coalesce(1), str(out))
    text = "".join(open(f).read() for f in out.glob("part-*"))
    assert text.splitlines()[0] == "Env,Hybrid,Yield_Mg_ha"


def test_genotype_text_round_trip(spark, tmp_path):
    g = spark.createDataFrame([("H1", [0.0, 0.5, None]), ("H2", [1.0, None, 0.5])],
                              "Hybrid string, dosage array<double>")
    out = str(tmp_path / "geno")
    TX.write_genotype_text(g, ["m1", "m2", "m3"], out)
    back, markers = TX.read_genotype_text(spark, out)
    assert sorted((r["Hybrid"], r["dosage"]) for r in back.collect()) == \
        [("H1", [0.0, 0.5, None]), ("H2", [1.0, None, 0.5])]
    assert [r["marker"] for r in markers.orderBy("i").collect()] == ["m1", "m2", "m3"]


def test_genotype_text_in_many_parts_of_uneven_size(spark, tmp_path):
    rows = [(f"H{i:03d}", [0.0, 0.5, None, 1.0]) for i in range(200)]
    g = spark.createDataFrame(rows, "Hybrid string, dosage array<double>")
    # the last part is by far the largest, and one is empty
    part = F.when(F.col("Hybrid") < "H040", F.substring("Hybrid", 2, 2).cast("int") % 8).otherwise(9)
    out = str(tmp_path / "geno")
    TX.write_genotype_text(g.repartitionByRange(10, part), [f"m{i}" for i in range(4)], out)
    back, markers = TX.read_genotype_text(spark, out)
    assert sorted((r["Hybrid"], r["dosage"]) for r in back.collect()) == rows
    assert [r["marker"] for r in markers.orderBy("i").collect()] == ["m0", "m1", "m2", "m3"]


def test_genotype_text_written_by_another_tool(spark, tmp_path):
    p = tmp_path / "numerical.txt"
    p.write_text("Genotype\tS1_100\tS1_200\nA/B\t0\t0.5\nC/D\tNA\t1\n")
    back, markers = TX.read_genotype_text(spark, str(p))
    got = {r["Hybrid"]: r["dosage"] for r in back.collect()}
    assert got == {"A/B": [0.0, 0.5], "C/D": [None, 1.0]}
    assert markers.count() == 2


def test_vcf_as_plain_table(spark, tmp_path):
    p = tmp_path / "x.vcf"
    p.write_text("##fileformat=VCFv4.2\n##source=x\n#CHROM\tPOS\tID\tREF\tALT\tS1\tS2\n"
                 "1\t100\tm1\tA\tG\t0/1\t1/1\n2\t200\tm2\tC\tT\t0/0\t./.\n")
    df = TX.read_vcf_table(spark, str(p))
    assert df.columns == ["CHROM", "POS", "ID", "REF", "ALT", "S1", "S2"]
    assert [r["S2"] for r in df.orderBy("POS").collect()] == ["1/1", "./."]
    assert df.filter(F.col("CHROM") == "2").count() == 1

from tallygrid.functions.sizing import broadcast_if, estimated_bytes, fits


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_sizes_decide_on_broadcasts(spark, model_of):
    small = model_of(redes=[(1, "n", "N")]).table("redes")
    unknown = spark.createDataFrame([(1,)], "id long")
    assert estimated_bytes(small) < 1000 and fits(small) and not fits(unknown) and not fits(small, unknown)
    other = spark.range(3)
    assert "strategy=broadcast" in plan(other.join(broadcast_if(small, small), "id"))
    assert "strategy=broadcast" not in plan(other.join(broadcast_if(small, unknown), "id"))


def test_nothing_fits_without_a_threshold(model_of, nothing_fits):
    assert not fits(model_of().table("redes"))


def test_values_outside_the_chosen_facts_are_not_read(spark, tmp_path, nothing_fits):
    from tallygrid.operators import export
    from tallygrid.sources.model import Model

    tables = {
        "series": spark.range(1).selectExpr("1L id", "5L estacion_id", "2L var_id", "1L proc_id", "1L unit_id"),
        "observaciones": spark.range(10_000).selectExpr(
            "id", "1L series_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, cast(id as int)) timestart"),
    }
    values = str(tmp_path / "values")
    spark.range(0, 10_000, 1, 20).selectExpr("id obs_id", "id / 2.0 valor").write.parquet(values)
    found = export.levels(Model(spark, lambda name: tables.get(name) or spark.read.parquet(values)), 5, "2024-02-01", "2024-02-05")
    rows = found.collect()
    assert len(rows) == 4 * 24 + 1 and [r.valor for r in rows] == [i / 2 for i in range(744, 841)]

    def leaves(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            yield from leaves(plan.executedPlan())
        elif name.endswith("QueryStageExec"):
            yield from leaves(plan.plan())
        elif plan.children().isEmpty():
            yield plan
        for i in range(plan.children().size()):
            yield from leaves(plan.children().apply(i))

    scans = [leaf for leaf in leaves(found._jdf.queryExecution().executedPlan()) if "values" in leaf.toString()]
    assert scans and all("obs_id" in scan.toString() for scan in scans)
    # Of twenty files of 500 values each, two hold the 97 chosen ones.
    assert max(scan.metrics().apply("numOutputRows").value() for scan in scans) <= 1000

"""The five CSV files end to end, on hand-written rows with known answers."""

import re

import pytest

from lapsekit.plans import blocks
from lapsekit.plans.features import feature_names, feature_table
from lapsekit.plans.specs import MEALS
from lapsekit.plans.study import ChurnStudy
from lapsekit.sources.readers import name_view, preview, read_csv, read_sources, total_rows
from lapsekit.sources.schemas import SCHEMAS

FILES = {
    "subscriptions": """\
SubscriptionID,CustomerID,StartDate,EndDate,RenewalDate,PaymentDate,FormulaID,ProductName,NbrMeals_REG,NbrMeals_EXCEP,\
GrossFormulaPrice,NetFormulaPrice,NbrMealsPrice,ProductDiscount,FormulaDiscount,TotalDiscount,TotalPrice,TotalCredit,Extra
10,1,2017/01/01,2017/12/31,2018-01-01,2017-01-05,1,Grub Mini,9,1,100,90,2.50,0,10,10,90,0,x
11,1,2018/01/01,2018/12/31,NA,2018-01-05,2,Grub Maxi (incl. staff),10,NA,200,180,3.25,0,20,20,180,NA,x
20,2,2018/06/01,2019/05/31,NA,NA,1,Custom Events,5,2,50.9,50,1.10,0,0,0,50,0,x
30,3,2018/06/01,2018/12/31,NA,2018-06-02,9,Unheard of,NA,NA,NA,NA,NA,NA,NA,NA,NA,NA,x
31,3,2018/02/01,2018/12/31,2018-11-01,2018-02-02,,Grub Mini,1,1,1,1,1,1,1,1,1,1,x
40,4,2016/02/01,NA,NA,2016-02-02,1,Grub Mini,1,1,1,1,1,1,1,1,1,1,x
50,NA,2016/02/01,2016/03/01,NA,2016-02-02,1,Grub Mini,1,1,1,1,1,1,1,1,1,1,x
""",
    "complaints": """\
ComplaintID,CustomerID,ComplaintDate,ProductID,ProductName,ComplaintTypeID,ComplaintTypeDesc,SolutionTypeID,\
SolutionTypeDesc,FeedbackTypeID,FeedbackTypeDesc
1,1,2018/05/01,1,Grub Mini,1,late delivery,1,no compensation,1,satisfied
2,1,2019/03/01,1,NA,1,other,1,NA,1,NA
3,1,2018/05/01,1,Grub Mini,1,NA,1,other,1,other
4,77,2018/05/01,1,Grub Mini,1,poor hygiene,1,no compensation,1,satisfied
""",
    "customers": "CustomerID,Region\n1,5\n2,7\n3,\n",
    "delivery": """\
DeliveryID,SubscriptionID,DeliveryClass,DeliveryTypeName,DeliveryDate
1,10,NOR,delivery w/ staff,2017/02/01
2,11,ABN,delivery w/o staff,2018/02/01
3,11,null,NA,2018/03/01
4,99,NOR,delivery w/ staff,2018/03/01
5,20,NOR,,2019/03/01
""",
    "formula": "FormulaID,FormulaType\n1,A\n2,B\n3,C\n",
}


@pytest.fixture(scope="module")
def paths(tmp_path_factory):
    folder = tmp_path_factory.mktemp("csv")
    for name, text in FILES.items():
        (folder / f"{name}.csv").write_text(text)
    return {name: str(folder / f"{name}.csv") for name in FILES}


@pytest.fixture(scope="module")
def tables(spark, paths):
    return read_sources(spark, paths, date_format="yyyy/MM/dd")


@pytest.fixture(scope="module")
def features(tables):
    return {r["CustomerID"]: r.asDict() for r in feature_table(tables, MEALS).collect()}


def test_schemas_do_not_depend_on_column_order(tables):
    for name, df in tables.items():
        assert df.schema.names == SCHEMAS[name].names
    assert dict(tables["subscriptions"].dtypes)["EndDate"] == "date"


def test_missing_columns_are_reported(spark, paths):
    with pytest.raises(ValueError, match="lacks"):
        read_csv(spark, paths["formula"], SCHEMAS["customers"])
    with pytest.raises(ValueError, match="unknown"):
        read_sources(spark, {"nothing": paths["formula"]})


def test_inference_is_an_option(spark, paths):
    assert dict(read_csv(spark, paths["subscriptions"]).dtypes)["NbrMeals_EXCEP"] == "string"
    assert dict(read_csv(spark, paths["subscriptions"], null_value="NA").dtypes)["NbrMeals_EXCEP"] == "int"


def test_views_previews_and_counts(spark, tables):
    name_view(tables["formula"], "formula_view")
    assert spark.sql("SELECT count(*) FROM formula_view").first()[0] == 3
    assert preview(tables["formula"], 2).count() == 2
    assert total_rows(tables["delivery"]).first()["n_rows"] == 5


def test_one_row_per_known_customer(features):
    assert sorted(features) == [1, 2, 3, 4]


def test_labels(features):
    assert {k: r["label"] for k, r in features.items()} == {1: 1, 2: 0, 3: 0, 4: 0}


def test_subscription_features(features):
    one, three = features[1], features[3]
    assert (one["TotalGrubMini"], one["TotalGrubMaxi"], one["TotalCustomEvents"]) == (1, 1, 0)
    assert (one["avg_NbrMeals_REG"], one["max_NbrMeals_REG"]) == (9.5, 10.0)
    assert (one["avg_NbrMealsEXCEP"], one["min_NbrMealsEXCEP"]) == (1.0, 1.0)
    assert one["avg_Price_per_meal"] == 2.88
    assert (one["count_Price_Total"], one["count_Credit_Total"], three["count_Price_Total"]) == (2, 1, 1)
    assert features[2]["max_GrossPrice_Formula"] == 50.0
    assert one["AggSubscriptionDuration"] == 364 + 364
    assert (one["NbDayLastPayment"], one["NbDayLastRenewal"]) == (27 + 365, 31 + 365)
    assert (one["Sub_2017"], one["Sub_2018"], one["Sub_2014"], one["TotalSubscriptions"]) == (1, 1, 0, 2)
    assert (one["A"], one["B"], one["C"]) == (1, 1, 0) and (three["A"], three["B"]) == (0, 0)


def test_complaint_features(features):
    one = features[1]
    assert (one["Complaint_Late_Delivery"], one["Complaint_Other"], one["Other_Complaint"]) == (1, 1, 1)
    assert (one["Sol_Other"], one["Sol_No_Compensation"], one["Other_Product"], one["Grub Mini"]) == (2, 1, 1, 2)
    assert (one["No_Feedback"], one["Satisfied"], one["Other_Feedback"]) == (1, 1, 1)
    assert one["NbrTotalComplaints"] == 11
    assert one["NbDayLastComplaint"] == -28
    assert features[2]["NbrTotalComplaints"] == 0 and features[2]["NbDayLastComplaint"] == 0


def test_delivery_and_region_features(features):
    one, two = features[1], features[2]
    assert (one["Delivery_With_Staff"], one["Delivery_Without_Staff"], one["DropOff_Delivery"]) == (1, 1, 0)
    assert (one["Normal_Delivery"], one["Abnormal_Delivery"], one["Not_Specified"]) == (1, 1, 1)
    assert one["NbDayLastDelivery"] == 337 and two["NbDayLastDelivery"] == -28 and two["Normal_Delivery"] == 1
    assert [features[k]["Region_Cust"] for k in (1, 2, 3, 4)] == ["Region5", "Region7", None, None]


def test_large_formula_table_takes_the_shuffle_route(tables, features):
    other = feature_table(tables, MEALS, broadcast_rows=1)
    assert {r["CustomerID"]: r.asDict() for r in other.collect()} == features


def test_options(tables):
    from dataclasses import replace

    rows = feature_table(tables, replace(MEALS, missing="zero", end_fallback=True, recency_fill=-1.0)).collect()
    got = {r["CustomerID"]: r for r in rows}
    assert got[1]["avg_NbrMealsEXCEP"] == 0.5 and got[1]["count_Credit_Total"] == 2
    assert got[1]["NbDayLastRenewal"] == 32
    assert got[2]["NbDayLastPayment"] == -119
    assert got[2]["NbDayLastComplaint"] == -1


def test_one_date_format_throughout(spark, tables, features, tmp_path):
    from dataclasses import replace

    folder = tmp_path / "slashed"
    folder.mkdir()
    for name, text in FILES.items():
        (folder / f"{name}.csv").write_text(re.sub(r"(\d{4})-(\d\d)-(\d\d)", r"\1/\2/\3", text))
    slashed = read_sources(spark, {n: str(folder / f"{n}.csv") for n in FILES}, date_format="yyyy/MM/dd")
    got = feature_table(slashed, replace(MEALS, date_format="yyyy/MM/dd")).collect()
    assert {r["CustomerID"]: r.asDict() for r in got} == features


def test_found_categories_have_columns_by_default(tables, features):
    assert features[1]["DeliveryTypeName_NA"] == 1
    from dataclasses import replace

    declared = feature_table(tables, replace(MEALS, categories="declared")).collect()
    got = {r["CustomerID"]: r.asDict() for r in declared}
    assert got[1]["DeliveryTypeName_undeclared"] == 1 and "DeliveryTypeName_NA" not in got[1]
    dotted = tables["complaints"].replace({"late delivery": "St. late"}, subset=["ComplaintTypeDesc"])
    again = {r["CustomerID"]: r for r in feature_table({**tables, "complaints": dotted}, MEALS).collect()}
    assert again[1]["ComplaintTypeDesc_St_ late"] == 1 and again[1]["NbrTotalComplaints"] == features[1]["NbrTotalComplaints"] - 1
    with pytest.raises(ValueError, match="more than 1 categories"):
        feature_table(tables, replace(MEALS, max_categories=1))


def test_undeclared_categories_can_be_added(tables):
    spec = blocks.with_found_categories(MEALS, tables["complaints"], tables["delivery"])
    assert spec.delivery_counts["DeliveryTypeName"]["NA"] == "DeliveryTypeName_NA"
    assert spec.complaint_counts == {k: dict(v) for k, v in MEALS.complaint_counts.items()}
    names = feature_names(blocks.with_formula_types(spec, tables["formula"]))
    assert "DeliveryTypeName_NA" in names


def test_a_repeated_customer_is_an_error(tables):
    doubled = {**tables, "customers": tables["customers"].unionAll(tables["customers"])}
    with pytest.raises(Exception, match="more than one row for CustomerID"):
        feature_table(doubled, MEALS).collect()


def test_a_name_used_twice_is_an_error():
    from dataclasses import replace

    with pytest.raises(ValueError, match="label"):
        feature_names(replace(MEALS, formula_types=("label",)))


def test_a_study_can_start_from_the_files(tables):
    with ChurnStudy(feature_table(tables, MEALS)) as study:
        assert study.features.count() == 4 and "Grub Mini" in study.candidates

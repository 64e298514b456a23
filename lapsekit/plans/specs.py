"""What differs between data sets: dates, categories and output names."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date

# Source measure -> (feature name, type it is read as).
MEASURES = {
    "NbrMeals_REG": ("NbrMeals_REG", "double"),
    "NbrMeals_EXCEP": ("NbrMealsEXCEP", "int"),
    "GrossFormulaPrice": ("GrossPrice_Formula", "int"),
    "NetFormulaPrice": ("NetPrice_Formula", "int"),
    "NbrMealsPrice": ("Price_per_meal", "double"),
    "ProductDiscount": ("Discount_Product", "int"),
    "FormulaDiscount": ("Discount_Formula", "int"),
    "TotalDiscount": ("Discount_Total", "int"),
    "TotalPrice": ("Price_Total", "int"),
    "TotalCredit": ("Credit_Total", "int"),
}
EVENT_DATES = {
    "RenewalDate": ("Date_Renewal", "moment"),
    "PaymentDate": ("Date_Payment", "moment"),
}
COUNTED = ("Price_Total", "Credit_Total")
UNROUNDED = ("Credit_Total",)


@dataclass(frozen=True)
class ChurnSpec:
    """Everything the feature blocks need to know about a data set.

    ``missing`` keeps unreadable measures out of the statistics (``ignore``) or
    counts them as 0 (``zero``). ``end_fallback`` lets a missing payment or renewal
    date take the end date. ``recency_fill`` replaces 0 as the recency of customers
    without any event. ``formula_types`` left empty is read from the formula table.
    ``exact_scale`` names measures whose means are summed as decimals of so many
    places. ``date_format`` is that of payment and renewal dates (ISO without it).
    ``categories`` says what becomes of complaint and delivery categories that are
    not declared: ``found`` gives each its own column, at most ``max_categories``
    per source column (more are an error), ``declared`` counts them together as
    ``<column>_undeclared``.
    """

    as_of: date
    current_year: int
    years: tuple[int, ...]
    products: Mapping[str, str]
    complaint_recodes: Mapping[str, Mapping[str, str]]
    complaint_counts: Mapping[str, Mapping[str, str]]
    delivery_recodes: Mapping[str, Mapping[str, str]]
    delivery_counts: Mapping[str, Mapping[str, str]]
    formula_types: tuple[str, ...] = ()
    key: str = "CustomerID"
    sentinel: str = "NA"
    missing: str = "ignore"
    end_fallback: bool = False
    recency_fill: float | None = None
    not_in_total: tuple[str, ...] = ("Other_Complaint",)
    exact_scale: Mapping[str, int] = field(default_factory=lambda: {"Price_per_meal": 10})
    date_format: str | None = None
    categories: str = "found"
    max_categories: int = 1000
    region_prefix: str = "Region"

    @property
    def measure_names(self) -> list[str]:
        return [name for name, _ in MEASURES.values()]

    @property
    def year_names(self) -> list[str]:
        return [f"Sub_{y}" for y in self.years]


# Categories of the meal-subscription files and their feature names.
MEALS = ChurnSpec(
    as_of=date(2019, 2, 1),
    current_year=2019,
    years=(2014, 2015, 2016, 2017, 2018, 2019),
    products={
        "Custom Events": "TotalCustomEvents",
        "Grub Flexi (excl. staff)": "TotalGrubFlexi",
        "Grub Mini": "TotalGrubMini",
        "Grub Maxi (incl. staff)": "TotalGrubMaxi",
    },
    complaint_recodes={
        "FeedbackTypeDesc": {"NA": "No_Feedback"},
        "ProductName": {"NA": "Other_Product"},
        "SolutionTypeDesc": {"NA": "Solution_Other", "other": "Solution_Other"},
        "ComplaintTypeDesc": {"other": "Diff_Complaint", "NA": "Other_Complaint"},
    },
    complaint_counts={
        "ComplaintTypeDesc": {
            "employees were rude": "Complaint_Employees_Rude",
            "billing/invoice not correct": "Complaint_Billing_Problem",
            "food quantity was insufficient": "Complaint_Quantity",
            "food quality not good": "Complaint_Quality",
            "food was cold": "Complaint_Food_Cold",
            "order not correct": "Complaint_Incorrect_Order",
            "Diff_Complaint": "Complaint_Other",
            "late delivery": "Complaint_Late_Delivery",
            "poor hygiene": "Complaint_Poor_Hygiene",
            "Other_Complaint": "Other_Complaint",
        },
        "SolutionTypeDesc": {
            "exceptional price discount": "Sol_Excep_Discount",
            "free additional meal service": "Sol_Free_Service",
            "no compensation": "Sol_No_Compensation",
            "Solution_Other": "Sol_Other",
        },
        "ProductName": {
            "Other_Product": "Other_Product",
            "Custom Events": "Customer_Events",
            "Grub Flexi (excl. staff)": "Grub Flexi",
            "Grub Mini": "Grub Mini",
            "Grub Maxi (incl. staff)": "Grub Maxi",
        },
        "FeedbackTypeDesc": {
            "No_Feedback": "No_Feedback",
            "not satisfied": "Not_Satisfied",
            "no response": "No_Response",
            "other": "Other_Feedback",
            "satisfied": "Satisfied",
        },
    },
    delivery_recodes={"DeliveryClass": {"null": "Not_Specified"}},
    delivery_counts={
        "DeliveryTypeName": {
            "delivery w/ staff": "Delivery_With_Staff",
            "drop off)": "DropOff_Delivery",
            "delivery w/o staff": "Delivery_Without_Staff",
        },
        "DeliveryClass": {
            "NOR": "Normal_Delivery",
            "ABN": "Abnormal_Delivery",
            "Not_Specified": "Not_Specified",
        },
    },
)

# The same shape over the test tables. Some categories are left to be found.
STANDIN = ChurnSpec(
    as_of=date(2001, 8, 1),
    current_year=2001,
    years=(1995, 1996, 1997, 1998, 1999, 2000, 2001),
    products={
        "1-URGENT": "TotalUrgent",
        "2-HIGH": "TotalHigh",
        "3-MEDIUM": "TotalMedium",
        "5-LOW": "TotalLow",
    },
    complaint_recodes=MEALS.complaint_recodes,
    complaint_counts={
        "ComplaintTypeDesc": {
            "click": "Complaint_Click",
            "purchase": "Complaint_Purchase",
            "Diff_Complaint": "Complaint_Other",
            "Other_Complaint": "Other_Complaint",
        },
        "SolutionTypeDesc": {
            "discount": "Sol_Discount",
            "free service": "Sol_Free_Service",
            "no compensation": "Sol_No_Compensation",
            "Solution_Other": "Sol_Other",
        },
        "ProductName": {
            "Other_Product": "Other_Product",
            "basic": "Product_Basic",
            "plus": "Product_Plus",
            "family": "Product_Family",
            "event": "Product_Event",
        },
        "FeedbackTypeDesc": MEALS.complaint_counts["FeedbackTypeDesc"],
    },
    delivery_recodes=MEALS.delivery_recodes,
    delivery_counts={
        "DeliveryTypeName": {"A": "Delivery_A"},
        "DeliveryClass": {"F": "Delivery_F", "O": "Delivery_O"},
    },
    formula_types=("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"),
)

"""Declared schemas of the five source tables.

Measures and optional dates stay text because the files write missing values as
``NA``; ``lapsekit.operators.columns.convert`` types them. Declaring the schema
saves the full scan that inference costs per file.
"""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT, _KEY, _DAY = T.StringType(), T.LongType(), T.DateType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


SUBSCRIPTIONS = _schema(
    CustomerID=_KEY,
    SubscriptionID=_KEY,
    StartDate=_DAY,
    EndDate=_DAY,
    RenewalDate=_TEXT,
    PaymentDate=_TEXT,
    FormulaID=_KEY,
    ProductName=_TEXT,
    NbrMeals_REG=_TEXT,
    NbrMeals_EXCEP=_TEXT,
    GrossFormulaPrice=_TEXT,
    NetFormulaPrice=_TEXT,
    NbrMealsPrice=_TEXT,
    ProductDiscount=_TEXT,
    FormulaDiscount=_TEXT,
    TotalDiscount=_TEXT,
    TotalPrice=_TEXT,
    TotalCredit=_TEXT,
)

COMPLAINTS = _schema(
    ComplaintID=_KEY,
    CustomerID=_KEY,
    ComplaintDate=_DAY,
    ProductID=_TEXT,
    ProductName=_TEXT,
    ComplaintTypeID=_TEXT,
    ComplaintTypeDesc=_TEXT,
    SolutionTypeID=_TEXT,
    SolutionTypeDesc=_TEXT,
    FeedbackTypeID=_TEXT,
    FeedbackTypeDesc=_TEXT,
)

CUSTOMERS = _schema(CustomerID=_KEY, Region=_TEXT)

DELIVERY = _schema(
    DeliveryID=_KEY,
    SubscriptionID=_KEY,
    DeliveryClass=_TEXT,
    DeliveryTypeName=_TEXT,
    DeliveryDate=_DAY,
)

FORMULA = _schema(FormulaID=_KEY, FormulaType=_TEXT)

SCHEMAS = {
    "subscriptions": SUBSCRIPTIONS,
    "complaints": COMPLAINTS,
    "customers": CUSTOMERS,
    "delivery": DELIVERY,
    "formula": FORMULA,
}

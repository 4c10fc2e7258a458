from entitle.operators.rules import compile_rules
from entitle.schema import PROFILE

SCHEMES = ("pos int, id string, name string, state string, category string, description string, keywords string, "
           "documents array<string>, eligibility struct<age:string,income:string,category:string,occupation:string>")


def scheme(pos, age="All", income="All", category="All", occupation="All", state="Central", name=None, **more):
    row = {"pos": pos, "id": f"s-{pos}", "name": name or f"scheme {pos}", "state": state, "category": "education",
           "description": "text", "keywords": "words", "documents": ["Card"], **more}
    return (row["pos"], row["id"], row["name"], row["state"], row["category"], row["description"], row["keywords"],
            row["documents"], (age, income, category, occupation))


def catalogue(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMES)


def rules(spark, dialect, *rows):
    return compile_rules(catalogue(spark, *rows), dialect)


def profiles(spark, *rows):
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], PROFILE)


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]

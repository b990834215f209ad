"""Word lists behind the name- and text-based rules.

All tables in this module are fixed values: results depend on the exact words
and, where a rule says "first match", on their order.
"""

# Column meaning by words contained in its lower-cased name, first match wins.
SEMANTIC_WORDS = [
    ("id", ["id", "_id", "uuid", "identifier", "key"]),
    ("datetime", ["date", "time", "created", "updated", "timestamp", "dt", "published",
                  "start_date", "end_date"]),
    ("money", ["price", "cost", "revenue", "amount", "salary", "wage", "fee", "income", "expense",
               "budget", "profit", "loss", "earning", "rate", "interest"]),
    ("count", ["quantity", "count", "num", "number", "units", "items", "stock", "inventory", "volume"]),
    ("percentage", ["percent", "ratio", "pct", "share"]),
    ("score", ["score", "rating", "grade", "gpa", "marks", "marks_"]),
    ("person", ["name", "first_name", "last_name", "full_name", "author", "user", "customer",
                "client", "patient", "doctor", "physician", "teacher", "student", "employee",
                "manager", "seller", "driver"]),
    ("location", ["region", "country", "city", "state", "location", "address", "zip", "postal",
                  "lat", "lon", "latitude", "longitude", "territory", "area", "district", "province"]),
    ("category", ["category", "type", "status", "department", "genre", "group", "segment", "class",
                  "level", "tier", "plan"]),
    ("email", ["email", "mail"]),
    ("phone", ["phone", "mobile", "tel"]),
    ("url", ["url", "link", "website", "href", "domain"]),
    ("text", ["description", "text", "content", "body", "message", "summary", "headline", "title",
              "abstract", "notes", "comment", "review"]),
    ("medical_term", ["diagnosis", "treatment", "medication", "symptom", "dosage", "prescription",
                      "lab_result", "blood_pressure", "heart_rate", "pulse", "disease", "condition",
                      "procedure"]),
    ("score", ["attendance", "homework", "assignment", "semester", "lecture", "course", "school",
               "university", "college", "exam", "midterm", "final_exam", "study_hours", "sleep_hours",
               "extra_classes", "parent_education", "internet_access", "participation_score",
               "overall_score"]),
    ("text", ["headline", "source", "publisher", "journalist", "edition"]),
]

# The shorter rule set used for workbook columns, first match wins.
WORKBOOK_SEMANTIC_WORDS = [
    ("id", ["id", "_id", "key", "uuid"]),
    ("datetime", ["date", "time", "created", "updated", "dt"]),
    ("money", ["price", "cost", "revenue", "amount", "salary", "fee"]),
    ("count", ["count", "quantity", "qty", "num", "number"]),
    ("category", ["category", "type", "status", "department", "class"]),
    ("location", ["city", "state", "country", "region", "location", "address"]),
    ("name", ["name", "title", "product", "item", "customer", "client"]),
]

# Dataset type by exact lower-cased column names, with the weight of each hit.
# Ties go to the type listed first.
DATASET_TYPE_WORDS = {
    "education": {
        3: ["student", "grade", "midterm", "final_exam", "attendance", "assignment", "exam", "gpa",
            "school", "university", "college", "teacher", "lecture", "course", "semester", "homework",
            "class", "study_hours", "participation_score", "overall_score", "sleep_hours",
            "extra_classes", "parent_education", "internet_access"],
        1: ["score", "pass", "fail"],
    },
    "medical": {
        3: ["patient", "diagnosis", "treatment", "medication", "symptom", "doctor", "physician",
            "hospital", "disease", "clinical", "dosage", "prescription", "lab_result",
            "blood_pressure", "heart_rate", "pulse", "procedure", "condition"],
        1: ["age", "gender", "weight", "height", "blood"],
    },
    "sales": {
        3: ["product", "sales", "revenue", "quantity", "price", "order", "customer", "invoice",
            "discount", "profit", "shipping", "amount", "seller", "store"],
        1: ["region", "total", "amount", "item"],
    },
    "news": {
        3: ["headline", "article", "publisher", "journalist", "edition", "byline"],
        1: ["title", "author", "source", "published", "category", "date"],
    },
    "finance": {
        3: ["stock", "ticker", "exchange", "portfolio", "dividend", "nasdaq", "market_cap",
            "closing_price", "opening_price", "share", "trade", "bid", "ask"],
        1: ["price", "volume", "market", "return", "change"],
    },
    "hr": {
        3: ["employee", "salary", "hire_date", "performance_review", "manager", "department",
            "position", "termination", "onboarding"],
        1: ["performance", "attendance"],
    },
    "ecommerce": {
        3: ["cart", "checkout", "sku", "wishlist", "coupon", "order_id", "order_item"],
        1: ["order", "shipping", "product", "quantity", "amount"],
    },
    "iot": {
        3: ["sensor", "device_id", "reading", "humidity", "pressure", "device"],
        1: ["temperature", "timestamp", "device"],
    },
    "logistics": {
        3: ["shipment", "carrier", "tracking", "delivery", "warehouse", "freight"],
        1: ["status", "date", "weight", "origin", "destination"],
    },
}

# Words that put a column into a role.
ID_NAME_WORDS = ["_id", "id_", "uuid", "identifier"]
DATE_TYPE_WORDS = ["DATE", "TIME", "TIMESTAMP"]
NUMERIC_TYPE_WORDS = ["INT", "FLOAT", "DOUBLE", "DECIMAL", "NUMERIC", "REAL", "BIGINT", "SMALLINT"]
CODED_CATEGORY_WORDS = ["category", "type", "status", "gender", "department"]
CATEGORY_WORDS = ["category", "type", "status", "gender", "department", "region", "country", "name"]

# What marks a text column as meant to be numeric.
NUMERIC_INTENT_SEMANTICS = ["money", "count", "score", "percentage", "numeric", "number", "age"]
NUMERIC_INTENT_WORDS = ["age", "count", "qty", "quantity", "price", "amount", "score", "number"]

# Command intent by words contained in the lower-cased text, first match wins.
INTENT_WORDS = {
    "ingest": ["upload", "ingest", "load", "import"],
    "analyze": ["analyze", "analysis", "inspect", "examine", "what is", "quality", "data quality"],
    "query": ["query", "show", "select", "find", "top", "average", "sum", "count", "how many", "trend",
              "total", "best", "worst", "compare", "by region", "by product", "monthly", "yearly"],
    "generate_dbt": ["dbt", "generate dbt", "create models", "transform models"],
    "transform": ["clean", "transform", "process data", "normalize", "wash", "preprocess",
                  "clean data", "clean the data", "transform data", "normalize data"],
    "pipeline": ["pipeline", "etl", "process", "run pipeline", "build pipeline", "full pipeline",
                 "run all", "execute pipeline"],
    "report": ["report", "summary", "export", "download", "generate report", "create report"],
    "schema": ["schema", "columns", "structure", "describe"],
    "help": ["help", "what can you do", "commands", "list", "options"],
}

# Statement screening on the upper-cased text, first match wins.
STATEMENT_RULES = [
    (r"\bDROP\s+TABLE\b", "DROP TABLE is not allowed"),
    (r"\bDELETE\s+FROM\b", "DELETE FROM is not allowed"),
    (r"\bTRUNCATE\b", "TRUNCATE is not allowed"),
    (r"\bALTER\s+TABLE\b", "ALTER TABLE is not allowed"),
    (r"\bCREATE\s+DATABASE\b", "CREATE DATABASE is not allowed"),
    (r"\bGRANT\b", "GRANT is not allowed"),
    (r"\bREVOKE\b", "REVOKE is not allowed"),
    (r"\bATTACH\b", "ATTACH is not allowed"),
    (r"\bCOPY\s+.*\bFROM\s+.*HTTP", "COPY FROM URL is not allowed"),
    (r";\s*\w", "Multiple statements are not allowed"),
]

# Words a strictly screened statement may not contain anywhere.
STRICT_WORDS = ["DROP", "DELETE", "UPDATE", "INSERT", "ALTER", "CREATE", "TRUNCATE", "GRANT", "REVOKE"]

# Named query by words contained in the lower-cased question.
PATTERN_WORDS = {
    "top_products": ["top", "product", "best product", "popular product"],
    "by_region": ["by region", "region", "geographic", "location"],
    "monthly_trend": ["monthly", "trend", "over time", "timeline"],
    "total_revenue": ["total revenue", "total sales", "overall"],
    "average_sales": ["average", "avg", "mean"],
    "best_product": ["best", "top 1", "highest", "most successful"],
    "worst_product": ["worst", "bottom", "lowest", "least"],
    "top_sources": ["source", "publisher", "news outlet"],
    "by_category": ["category", "by category", "categories"],
    "most_shared": ["shared", "viral", "most shared"],
    "sentiment_analysis": ["sentiment", "feeling", "tone"],
    "top_authors": ["author", "writer", "journalist"],
    "viral_articles": ["viral", "trending", "popular"],
    "positive_news": ["positive", "good news", "happy"],
    "negative_news": ["negative", "bad news"],
    "top_diagnoses": ["diagnosis", "condition", "disease"],
    "by_department": ["department", "unit", "ward"],
    "age_distribution": ["age", "age group", "demographic"],
    "gender_breakdown": ["gender", "sex", "male female"],
    "monthly_admissions": ["admission", "monthly patient"],
    "treatment_outcomes": ["outcome", "result", "recovery"],
    "insurance_analysis": ["insurance", "coverage"],
    "high_cost_patients": ["expensive", "high cost", "costly"],
    "common_medications": ["medication", "drug", "prescription"],
    "top_holdings": ["holding", "portfolio", "position"],
    "by_sector": ["sector", "industry", "market segment"],
    "daily_volume": ["volume", "daily", "trading volume"],
    "profitable_trades": ["profit", "gain", "profitable"],
    "broker_comparison": ["broker", "platform"],
    "monthly_performance": ["monthly performance", "month over month"],
    "high_value_transactions": ["large", "big transaction", "high value"],
}

# Limits spelled out in a question, first match wins.
SPOKEN_LIMITS = [(1, ["top one", "the best"]), (3, ["top three"]), (5, ["top five"]), (10, ["top ten"])]

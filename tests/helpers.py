import datetime as dt

from ledgerspark import schemas as S


def txn_frame(spark, rows):
    """rows: (id, user_id, date, amount, category[, merchant[, description]])"""
    full = []
    for r in rows:
        r = list(r) + [None] * (7 - len(r))
        d = r[2] if isinstance(r[2], dt.date) else dt.date.fromisoformat(r[2])
        full.append((int(r[0]), int(r[1]), d, float(r[3]), r[4], r[5], r[6], None, None))
    return spark.createDataFrame(full, S.TRANSACTIONS)


def users_frame(spark, rows):
    """rows: (user_id, monthly_income)"""
    return spark.createDataFrame(
        [(int(u), f"u{u}@example.com", None, float(inc), "INR", None) for u, inc in rows], S.USERS
    )


def D(s):
    return dt.date.fromisoformat(s)

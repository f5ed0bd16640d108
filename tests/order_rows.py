"""Orders from short rows, one step apart."""
from datetime import datetime, timedelta

T0 = datetime(2024, 1, 1)


def make_orders(spark, rows, step=timedelta(hours=7), lag=timedelta(days=2)):
    """(phone, device, addr, vpa, ip, rto) rows -> orders, one step apart."""
    data = []
    for i, (phone, device, addr, vpa, ip, rto) in enumerate(rows):
        ts = T0 + step * i
        data.append((f"o{i}", i, ts, ts + lag, bool(rto), phone, device, addr, vpa, ip, "560034", 100.0 + i))
    return spark.createDataFrame(data, "order_id string, seq long, ts timestamp, outcome_ts timestamp, rto boolean, phone string, device string, "
                                       "addr string, vpa string, ip string, delivery_pin string, cart_gmv double")

"""Hand-made packets and a plain sequential model of flow segmentation to test against."""

from flowloom.operators.flows import SECOND

PACKET_DDL = ("packet_id bigint, ts_us bigint, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, "
              "header_len int, payload_len int, packet_len int, tcp_flags int, window_size int")


def packet(i, seconds, fwd=True, length=100, flags=16, payload=None, window=1000, port=1, proto=6):
    a, b = ("10.0.0.1", port), ("10.0.0.2", 443)
    (sip, sport), (dip, dport) = (a, b) if fwd else (b, a)
    payload = length - 40 if payload is None else payload
    return (i, round(seconds * SECOND), sip, dip, sport, dport, proto, 40, payload, length, flags, window)


def frame(spark, packets):
    return spark.createDataFrame(packets, PACKET_DDL)


def walk(packets, rules):
    """`{packet_id: flow_pos}` of one key's packets, by stepping through them."""
    out, begin, n, start, last, closing, open_ = {}, 0, 0, 0, 0, False, False
    for at, p in enumerate(sorted(packets, key=lambda p: (p[1], p[0]))):
        ts = p[1]
        if not open_ or ts - last > rules.idle_timeout:
            begin, n, start, closing, open_ = at, 0, ts, False, True
        n, last = n + 1, ts
        closing = closing or bool(p[10] & 5)
        out[p[0]] = begin
        if (n >= rules.max_packets or ts - start > rules.active_timeout
                or (closing and n >= rules.min_closing_packets)):
            open_ = False
    return out

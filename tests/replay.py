"""Slow event-by-event replays in plain Python, used as oracles."""
from __future__ import annotations

from collections import defaultdict

KINDS = ("phone", "device", "addr", "vpa", "card", "ip")


def events(rows):
    """(ts, kind, seq, row) in replay order; orders come before outcomes of the same instant."""
    out = [(r["ts"], 0, r["seq"], r) for r in rows] + [(r["outcome_ts"], 1, r["seq"], r) for r in rows]
    return sorted(out, key=lambda e: e[:3])


def velocity(rows, serviceability, prior):
    seen, out = [], {}
    for ts, kind, seq, r in events(rows):
        if kind == 0:
            f = {}
            past = lambda k, c: [x for _, kk, _, x in seen if kk == k and x[c] == r[c]]
            for c in ("phone", "device", "addr", "delivery_pin"):
                done = past(1, c)
                bad = sum(x["rto"] for x in done)
                p, n = (prior, 25) if c == "delivery_pin" else (0.22, 3)
                f[f"{c}_rate"] = (bad + p * n) / (len(done) + n)
            f["total"] = len(past(0, "phone"))
            f["recent"] = len([x for x in past(0, "phone")[-40:] if (ts - x["ts"]).total_seconds() <= 30 * 86400])
            f["device_recent"] = len([x for x in past(0, "device")[-40:] if (ts - x["ts"]).total_seconds() <= 86400])
            f["devices"] = len({x["device"] for x in past(0, "phone")})
            f["phones_device"] = len({x["phone"] for x in past(0, "device")})
            f["phones_addr"] = len({x["phone"] for x in past(0, "addr")})
            f["tenure"] = min(730.0, (ts - past(0, "phone")[0]["ts"]).total_seconds() / 86400) if f["total"] else 0.0
            pin = past(0, "delivery_pin")
            f["pin_mean"] = sum(x["cart_gmv"] for x in pin) / len(pin) if pin else 900.0
            tried = past(1, "delivery_pin")
            f["serviceability"] = (sum(not x["rto"] for x in tried) + serviceability * 25) / (len(tried) + 25) if tried else serviceability
            out[seq] = f
        seen.append((ts, kind, seq, r))
    return out


class Graph:
    """Entity graph rebuilt from its edge set whenever a component is asked for."""

    def __init__(self, guard=True, ceiling=6):
        self.guard, self.ceiling = guard, ceiling
        self.near, self.bridges = defaultdict(set), defaultdict(set)
        self.booked = defaultdict(lambda: [0, 0, 0])
        self.nodes, self.shared = set(), set()

    def place(self, nodes):
        self.nodes |= set(nodes)
        for a in nodes:
            self.near[a] |= set(nodes) - {a}
        phones = lambda n: sum(x.startswith("phone:") for x in self.near[n])
        for n in nodes:
            soft = n.startswith(("addr:", "ip:"))
            if soft and ((n.startswith("addr:") and phones(n) >= 25) or len(self.near[n]) >= 50):
                self.shared.add(n)
        ok = [n for n in nodes if not self.guard or n.startswith(("phone:", "device:", "vpa:", "card:")) or (n.startswith("addr:") and phones(n) < self.ceiling)]
        for n in ok[1:]:
            self.bridges[ok[0]].add(n)
            self.bridges[n].add(ok[0])
        self.booked[ok[0] if ok else nodes[0]][0] += 1

    def resolve(self, nodes, rto):
        self.booked[nodes[0]][1 if rto else 2] += 1

    def component(self, n):
        seen, todo = {n}, [n]
        while todo:
            for m in self.bridges[todo.pop()]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        return seen

    def stats(self, n):
        comp = self.component(n)
        count = lambda k: sum(x.startswith(k + ":") for x in comp)
        orders, rto, done = (sum(self.booked[x][i] for x in comp) for i in range(3))
        s = {"size": len(comp), "phones": count("phone"), "devices": count("device"), "addrs": count("addr"), "orders": orders, "rto": rto, "delivered": done}
        s["rate"] = rto / (rto + done) if rto + done else 0.0
        by_addr = s["phones"] / max(1, s["addrs"]) >= 2.5 and rto + done >= 5 and s["rate"] >= 0.45
        s["is_ring"] = s["phones"] >= 3 and (s["phones"] / max(1, s["devices"]) >= 2.5 or by_addr)
        s["degree"], s["shared"] = len(self.near[n]), n in self.shared
        return s


def ring_features(rows, published=True, guard=True, ceiling=6):
    g, board, out = Graph(guard, ceiling), {}, {}
    nodes_of = lambda r: [f"{k}:{r[k]}" for k in KINDS if r.get(k)]
    for _, kind, seq, r in events(rows):
        nodes = nodes_of(r)
        if kind == 0:
            known = [board[n] for n in nodes if n in board] if published else [g.stats(n) for n in nodes if n in g.nodes]
            best = {"size": 0, "phones": 0, "rate": 0.0, "is_ring": False}
            for s in known:
                if (s["size"], s["rate"]) > (best["size"], best["rate"]):
                    best = s
            if best["size"] <= 1:
                best = {"size": 0, "phones": 0, "rate": 0.0, "is_ring": False}
            out[seq] = (best["size"], best["phones"], round(best["rate"], 9), best["is_ring"],
                        max([s["degree"] for s in known], default=0), any(s["shared"] for s in known))
            if nodes:
                g.place(nodes)
        elif nodes:
            g.resolve(nodes, r["rto"])
        for n in nodes:
            board[n] = g.stats(n)
    return out

"""A plain sequential model of the detectors, used only to check the Spark plans.

It walks batches in order with one mutable record per source, one list of alerts
and wall time replaced by the batch's time.
"""

import hashlib
import math
import re
from dataclasses import dataclass, field

ERRORS = {"ERROR", "CRITICAL"}


def fp_of(message):
    return hashlib.sha256(re.sub(r"\d+", "N", message.lower().strip()).encode()).hexdigest()[:16]


@dataclass
class Source:
    m: float = 0.0
    v: float = 0.0
    n: int = 0
    vol: float = 0.0
    last: float = None
    clean: int = 0
    lclean: int = 0
    since: float = None
    fired: str = None
    lm: float = 0.0
    lv: float = 0.0
    ln: int = 0
    fps: dict = field(default_factory=dict)


class Model:
    def __init__(self, p):
        self.p, self.sources, self.alerts, self.cascade_at = p, {}, [], {}

    def emit(self, key, now, kind, severity, cur, base, bound, service, **more):
        a = dict(tenant=key[0], source=key[1], at=now, kind=kind, severity=severity, cur=cur, base=base,
                 bound=bound, service=service, status="open", resolved=None, **more)
        self.alerts.append(a)
        return a

    def resolve(self, key, kind, now):
        for a in reversed(self.alerts):
            if (a["tenant"], a["source"], a["kind"], a["status"]) == (*key, kind, "open"):
                a["status"], a["resolved"] = "resolved", now
                return

    def ingest(self, key, now, entries):
        """entries: (time, level, message, service, latency or None) in arrival order."""
        p, s = self.p, self.sources.setdefault(key, Source())
        times = [e[0] for e in entries]
        service = entries[0][3]
        if s.last is not None and min(times) - s.last >= p.silence_s:
            self.emit(key, now, "SERVICE_SILENCE", "CRITICAL", min(times) - s.last, s.vol, p.silence_s, service)
            self.resolve(key, "SERVICE_SILENCE", now)
        x = sum(e[1] in ERRORS for e in entries) / len(entries)
        pm, pv = s.m, s.v
        s.m, s.v = p.alpha * x + (1 - p.alpha) * pm, p.alpha * (x - pm) ** 2 + (1 - p.alpha) * pv
        s.n += 1
        lats = [e[4] for e in entries if e[4] is not None]
        plm, plv = s.lm, s.lv
        if lats:
            y = sum(lats) / len(lats)
            s.lm, s.lv = p.alpha * y + (1 - p.alpha) * plm, p.alpha * (y - plm) ** 2 + (1 - p.alpha) * plv
            s.ln += 1
        s.vol = p.alpha * len(entries) + (1 - p.alpha) * s.vol
        s.last = max(times)
        if s.n < p.warmup_required:
            return
        bound = pm + p.warn_k * math.sqrt(pv)
        if x > bound:
            s.clean = 0
            sev = "CRITICAL" if x > pm + p.crit_k * math.sqrt(pv) else "WARNING"
            self.emit(key, now, "ERROR_RATE_SPIKE", sev, x, s.m, bound, service)
            self.cascade(key, now)
        else:
            s.clean += 1
            if s.clean >= 2:
                self.resolve(key, "ERROR_RATE_SPIKE", now)
        if not x > s.m:
            s.since = s.fired = None
            self.resolve(key, "SUSTAINED_ELEVATION", now)
        elif s.since is None:
            s.since = now
        else:
            age = now - s.since
            if age >= p.sustained_crit_s and s.fired != "CRITICAL":
                s.fired = "CRITICAL"
                self.emit(key, now, "SUSTAINED_ELEVATION", "CRITICAL", x, s.m, s.m, "unknown")
            elif age >= p.sustained_warn_s and s.fired is None:
                s.fired = "WARNING"
                self.emit(key, now, "SUSTAINED_ELEVATION", "WARNING", x, s.m, s.m, "unknown")
        if lats and s.ln >= p.warmup_required:
            lb = plm + p.warn_k * math.sqrt(plv)
            if y > lb:
                s.lclean = 0
                sev = "CRITICAL" if y > plm + p.crit_k * math.sqrt(plv) else "WARNING"
                self.emit(key, now, "LATENCY_SPIKE", sev, y, s.lm, lb, service)
            else:
                s.lclean += 1
                if s.lclean >= 2:
                    self.resolve(key, "LATENCY_SPIKE", now)
        s.fps = {f: t for f, t in s.fps.items() if t > now - p.novel_ttl_s}
        for e in entries:
            f = fp_of(e[2])
            if e[1] in ERRORS and f not in s.fps:
                s.fps[f] = now
                self.emit(key, now, "NOVEL_ERROR", "WARNING", 1.0, 0.0, 0.0, e[3], message=e[2])

    def cascade(self, key, now):
        p, tenant = self.p, key[0]
        if tenant in self.cascade_at and now - self.cascade_at[tenant] < p.cascade_window_s:
            return
        services = {}
        for a in self.alerts:
            if a["tenant"] == tenant and a["kind"] == "ERROR_RATE_SPIKE" and a["status"] == "open" \
                    and a["at"] >= now - p.cascade_window_s:
                services.setdefault(a["service"], a)
        if len(services) >= p.cascade_min_services:
            self.cascade_at[tenant] = now
            self.emit(key, now, "CASCADE", "CRITICAL", float(len(services)), p.cascade_min_services - 1.0,
                      float(p.cascade_min_services), "unknown", members=sorted(services))

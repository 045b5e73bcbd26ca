"""Row-by-row restatements of the stateful rules, used to check the distributed versions."""

from __future__ import annotations

import re

S = 1_000_000


def direction(e):
    low = e["message"].lower()
    adj = e["mnemonic"] == "ADJCHANGE"
    if e["rule_id"] in ("BGP_DOWN", "BGP_MAXPFX") or (adj and "down" in low):
        return "down"
    if e["rule_id"] == "BGP_UP" or (adj and " up" in low):
        return "up"
    return None


def dedup(events, window=300 * S, flap=120 * S, bundle=60 * S):
    bundles, hist, anchors, out = {}, {}, {}, {}
    for e in sorted(events, key=lambda e: (e["us"], e["seq"])):
        t = e["us"]
        if e["bundle_parent"]:
            k = (e["device_name"], e["bundle_parent"])
            if k in bundles and t - bundles[k] <= bundle:
                out[e["seq"]] = "bundle_grouped"
                continue
            bundles[k] = t
        key = (e["device_name"], e["mnemonic"], e["bgp_neighbor"] or e["interface_name"])
        if e["bgp_neighbor"] and e["mnemonic"] == "ADJCHANGE" and direction(e):
            d = direction(e)
            pk = (e["device_name"], e["bgp_neighbor"])
            h = [x for x in hist.get(pk, []) if x[1] >= t - flap]
            states = [x[0] for x in h]
            hist[pk] = h + [(d, t)]
            if d == "down" and states[-2:] == ["down", "up"]:
                out[e["seq"]] = "flapping"
                continue
            if not states or states[-1] != d:
                anchors[key] = t
                out[e["seq"]] = "new"
                continue
        if key in anchors and t - anchors[key] <= window:
            out[e["seq"]] = "suppressed_duplicate"
        else:
            anchors[key] = t
            out[e["seq"]] = "new"
    return out


MASS = {"BGP Peer Down", "BGP Down", "Max Prefix", "BGP Max Prefix Reached"}


def correlate(events, links, ttl=24 * 3600 * S, window=60 * S, flapw=300 * S):
    """links: {(ip, bundle): remote_ip}. Returns {seq: label dict} and {incident: (resolved_us, by)}."""
    failures, registry, recent, out, closed = {}, {}, [], {}, {}
    by_link, by_device = {}, {}

    def live(ids):
        return [i for i in ids if i in registry]

    def open_incident(kind, key, device, e):
        iid = (kind, key, e["seq"])
        registry[iid] = []
        by_device.setdefault(device, []).append(iid)
        if kind == "link":
            by_link.setdefault(key, []).append(iid)
        return iid

    for e in sorted(events, key=lambda e: (e["us"], e["seq"])):
        t, ip = e["us"], e["source_ip"]
        for k in [k for k, v in failures.items() if v < t - window]:
            del failures[k]
        for i in [i for i, v in registry.items() if max(v) < t - ttl]:
            del registry[i]
        subject = e["bgp_neighbor"] or e["interface_name"] or e["mnemonic"]
        recent.append((t, ip, subject, e))
        flaps = sum(1 for r in recent if r[1] == ip and r[2] == subject and r[0] >= t - flapw)
        others = sum(
            1 for r in recent[:-1]
            if r[1] == ip and r[0] >= t - window and r[3]["event_type"] in MASS
            and r[3]["classification"] in ("CRITICAL", "WARNING"))

        link_inc = None
        if e["event_bundle"]:
            for (dev, bundle) in failures:
                local = dev == ip and bundle == e["event_bundle"]
                remote = links.get((dev, bundle)) == ip and e["event_remote"] == dev
                if local or remote:
                    ids = live(by_link.get((dev, bundle), []))
                    link_inc = ids[-1] if ids else open_incident("link", (dev, bundle), dev, e)
                    break
        fresh = False
        if e["interface_name"] and e["bundle_parent"] and e["member_bundle"] \
                and e["classification"] in ("CRITICAL", "WARNING"):
            k = (ip, e["member_bundle"])
            if re.search("Down|Fault", e["event_type"]):
                fresh = k not in failures
                failures[k] = t
            elif re.search("Up|Clear", e["event_type"]):
                failures.pop(k, None)

        def mass_live():
            ids = [i for i in live(by_device.get(ip, [])) if i[0] == "mass"]
            return ids[-1] if ids else None

        mass = None
        if e["event_type"] in MASS and others >= 2:
            cur = mass_live()
            mass = ("symptom", cur) if cur else ("root", open_incident("mass", ip, ip, e))
            registry[mass[1]].append(t)
        if link_inc is not None:
            registry[link_inc].append(t)
            res = mass or ("symptom", link_inc)
        elif fresh:
            iid = open_incident("link", (ip, e["member_bundle"]), ip, e)
            registry[iid].append(t)
            res = ("root", iid)
        elif mass:
            res = mass
        elif mass_live():
            res = ("symptom", mass_live())
            registry[res[1]].append(t)
        else:
            res = ("flapping" if flaps >= 3 else "independent", None)
        out[e["seq"]] = {"label": res[0], "inc": res[1], "flap_count": flaps}
        if e["is_recovery"]:
            for i in live(by_device.get(ip, [])):
                closed[i] = (t, e["seq"])
                del registry[i]
            by_device[ip] = []
    return out, closed

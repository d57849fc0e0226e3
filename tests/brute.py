"""Plain-Python versions of the order-dependent algorithms, written for small inputs."""


def iou(a, b):
    w = min(a["x2"], b["x2"]) - max(a["x1"], b["x1"])
    h = min(a["y2"], b["y2"]) - max(a["y1"], b["y1"])
    if w <= 0 or h <= 0:
        return 0.0
    size = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    return w * h / (size(a) + size(b) - w * h)


def greedy_match(preds, gts, t):
    """{pred_id: (gt_id or None, iou)} of one image."""
    free, out = sorted(gts, key=lambda g: g["gt_id"]), {}
    for p in sorted(preds, key=lambda r: (-r["score"], r["pred_id"])):
        best = max(free, key=lambda g: (iou(p, g), -g["gt_id"]), default=None)
        value = iou(p, best) if best else 0.0
        if best and value >= t:
            free = [g for g in free if g is not best]
            out[p["pred_id"]] = (best["gt_id"], value)
        else:
            out[p["pred_id"]] = (None, value)
    return out


def seeds(boxes, t):
    """{pred_id: seed id} of one image."""
    kept, out = [], {}
    for b in sorted(boxes, key=lambda r: (-r["score"], r["pred_id"])):
        hit = next((k for k in kept if iou(k, b) >= t), None)
        if hit is None:
            kept.append(b)
        out[b["pred_id"]] = (hit or b)["pred_id"]
    return out


def components(centres, link):
    """Sets of indices whose centres are linked, directly or through others."""
    left, out = set(range(len(centres))), []
    while left:
        todo, group = [left.pop()], set()
        while todo:
            i = todo.pop()
            group.add(i)
            near = {j for j in left if abs(centres[i][0] - centres[j][0]) <= link and abs(centres[i][1] - centres[j][1]) <= link}
            left -= near
            todo += near
        out.append(group)
    return out

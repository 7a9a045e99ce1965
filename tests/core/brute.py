"""Effect statistics of one period by dense matrices, written from the definitions and not from the catalogue's expressions."""

import numpy as np

P, ZP, ALPHA = 4, 3, 0.69


def off(m):
    """A matrix without its diagonal."""
    m = np.array(m, float)
    np.fill_diagonal(m, 0)
    return m


def safe(a, b):
    a, b = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float))
    return np.where(b != 0, a / np.where(b == 0, 1, b), 0)


class Period:
    """Matrices S, X (start and end), W, D, vectors v, c, zr, zr1 and the panel's constants."""

    def __init__(self, S, X, W, D, v, c, zr, zr1, k):
        self.__dict__.update(S=S, X=X, W=W, D=D, v=v, c=c, zr=zr, zr1=zr1, **k)
        self.z, self.z1 = zr - self.zmean, zr1 - self.zmean
        self.Dc = off(D - self.dmean)
        self.n = len(v)

    def sim(self, a, b, span, mean):
        return 1 - np.abs(a - b) / span - mean


def network_effects(p, over=None):
    """name -> sum over the ties of X, or over those of another matrix."""
    X, S, W, D, Dc, v, c, n = p.X, p.S, p.W, p.D, p.Dc, p.v, p.c, p.n
    one = np.ones((n, n))
    i, j = (lambda a: np.asarray(a, float)[:, None] * one), (lambda a: np.asarray(a, float)[None, :] * one)
    o, d, R = X.sum(1), X.sum(0), X * X.T
    r = R.sum(1)
    wo, wd, WR = W.sum(1), W.sum(0), W * W.T
    TP, IS, OS, RTP = off(X @ X), off(X @ X.T), off(X.T @ X), off(X.T @ X.T)
    E, WE = np.maximum(X, X.T), np.maximum(W, W.T)
    gw = lambda k: np.exp(ALPHA) * (1 - (1 - np.exp(-ALPHA)) ** k)
    f = {}
    f["density"], f["recip"] = one, X.T
    f["newrecip"] = X.T * ((S + S.T) == 0) * (1 - S)
    f["realrecip"], f["persistrecip"] = X.T * ((S + S.T) == 1), X.T * S * S.T
    for name in ("transTrip", "transTrip1", "transTrip2"):
        f[name] = TP
    f["transTriads"], f["transMedTrip"], f["transRecTrip"], f["cycle3"] = TP / 6, OS, X.T * TP, off(X.T @ X.T) / 3
    f["transRecTrip2"] = off(X @ R)
    f["transTies"] = TP > 0
    # Actors who reach j through i alone: h to i, not h to j.
    f["between"] = np.array([[sum(X[h, a] * (1 - X[h, b]) for h in range(n) if h not in (a, b)) for b in range(n)] for a in range(n)])
    f["inPop"], f["inPop.c"], f["inPopSqrt"] = j(d), j(d - p.adx), j(np.sqrt(d))
    f["outPop"], f["outPop.c"], f["outPopSqrt"] = j(o), j(o - p.adx), j(np.sqrt(o))
    f["outPopMore"], f["outPopSqrtMore"], f["outPopThreshold"] = j(np.maximum(o - P, 0)), j(np.maximum(np.sqrt(o) - np.sqrt(P), 0)), j(o > P)
    f["reciPop"], f["reciPopSqrt"] = j(r), j(np.sqrt(r))
    f["inAct"], f["inAct.c"], f["inActSqrt"] = i(d), i(d - p.adx), i(np.sqrt(d))
    f["reciAct"], f["degPlus"], f["degPlus.c"] = i(r), i(o) + j(d), i(o) + j(d) - 2 * p.adx
    f["outOutAss"], f["outInAss"], f["inOutAss"], f["inInAss"] = i(o) * j(o), i(o) * j(d), i(d) * j(o), i(d) * j(d)
    f["outAct_ego"], f["outActMore_ego"] = i(o - p.adx), i((o > P) * (o - P))
    f["outActSqrtMore_ego"], f["outMore_ego"] = i((o > P) * (np.sqrt(o) - np.sqrt(P))), i(o > P)
    f["inAct_ego"], f["reciAct_ego"], f["divOut_ego"], f["divIn_ego"], f["inPop_dya"] = i(d - p.adx), i(r - p.adr), i(safe(1, o)), i(safe(1, d)), j(d - p.adx)
    f["isolatePop"], f["inIsDegree"] = j((d == 1) & (o == 0)), i(d == 0)
    for name, k in (("FF", TP), ("FB", IS), ("BF", OS), ("BB", RTP), ("RR", off(R @ R))):
        f[f"gwesp{name}"] = gw(k)
    f["gwesp"] = gw(TP)
    f["Jin"], f["Jout"] = safe(OS, i(d) + j(d) - OS), safe(IS, i(o) + j(o) - IS)
    f["transTrip.FR"], f["transTrip.EE"], f["transTrip.FE"] = off(X @ R), off(E @ E), off(X @ E)
    f["balance"] = np.array([[sum(p.b0 - abs(X[a, h] - X[b, h]) for h in range(n) if h not in (a, b)) for b in range(n)] for a in range(n)])
    f["inStructEq"] = np.array([[sum(p.b0in - abs(X[h, a] - X[h, b]) for h in range(n) if h not in (a, b)) for b in range(n)] for a in range(n)])
    f["denseTriads"] = R * off(R @ R)
    XS = X * S
    f["agreetrans"], f["realtrans"] = (1 - S) * off(XS @ XS.T), (1 - S) * off(XS @ XS)
    # Covariates.
    f["altX"], f["altSqX"], f["altLThresholdX"], f["altRThresholdX"] = j(v), j(v**2), j(v <= 0), j(v >= 0)
    f["egoX"], f["egoX_gmm"], f["egoSqX"] = i(v), i(v), i(v**2)
    f["egoPlusAltX"], f["egoPlusAltSqX"], f["egoLThresholdX"], f["egoRThresholdX"] = i(v) + j(v), i(v**2) + j(v**2), i(v <= 0), i(v >= 0)
    f["diffX"], f["absDiffX"], f["diffSqX"], f["egoDiffX"] = j(v) - i(v), abs(j(v) - i(v)), (j(v) - i(v)) ** 2, (j(v) - i(v)) * i(v)
    sim = lambda a, b: p.sim(a, b, p.vrange, p.vsim)
    SIM = sim(i(v), j(v))
    f["simX"], f["simX_gmm"], f["simRecipX"], f["simRecipX_gmm"], f["simXTransTrip"] = SIM, SIM, X.T * SIM, X.T * SIM, SIM * TP
    same, diff = i(c) == j(c), i(c) != j(c)
    half = (i(v) > j(v)) + 0.5 * (i(v) == j(v))
    f["sameX"], f["unequalX"], f["higher"], f["altHigherEgoX"], f["sameXRecip"] = same, diff, half, (1 - 2 * half) * i(v), X.T * same
    f["egoXaltX"], f["egoXaltXRecip"] = i(v) * j(v), X.T * i(v) * j(v)
    f["inPopX"], f["outPopX"], f["inActX"], f["outActX"], f["altXOutAct"] = j(X.T @ v), j(X @ v), i(X.T @ v), i(X @ v), j(v) * i(X @ v)
    f["altDist2"], f["totDist2"] = j(safe(X @ v, o)), j(X @ v)
    f["altInDist2"], f["totInDist2"] = safe(j(X.T @ v) - i(v) * X, j(d) - X), j(X.T @ v) - i(v)
    f["simDist2"] = sim(i(safe(X @ v, o)), j(safe(X @ v, o)))
    f["simEgoInDist2"] = sim(i(v), safe(j(X.T @ v) - i(v) * X, j(d) - X))
    f["simEgoDist2"] = sim(i(v), safe(j(X @ v) - X.T * i(v), j(o) - X.T))
    f["simEgoDist2W"] = sim(i(v), safe(j(W @ v) - W.T * i(v), j(wo) - W.T))
    f["simEgoInDist2W"] = sim(i(v), safe(j(W.T @ v) - W * i(v), j(wd) - W))
    C = (c[:, None] == c[None, :]).astype(float)
    steps = lambda A, B, ok: np.array([[sum(A[a, h] * B[h, b] for h in range(n) if a != b and ok(c[a], c[h], c[b])) for b in range(n)] for a in range(n)])
    hom, jump = (lambda a, h, b: a == h == b), (lambda a, h, b: a == h != b)
    f["sameXTransTrip"], f["diffXTransTrip"] = same * TP, diff * TP
    f["sameXTransRecTrip"], f["diffXTransRecTrip"] = X.T * same * TP, X.T * diff * TP
    f["homXTransTrip"], f["jumpXTransTrip"], f["homXTransRecTrip"] = steps(X, X, hom), steps(X, X, jump), X.T * steps(X, X, hom)
    # Ties of i to, and of j from, actors of a category.
    to, fro, rec = X @ C, X.T @ C, R @ C
    f["sameXInPop"], f["diffXInPop"] = fro.T, j(d) - fro.T
    f["sameXOutAct"], f["diffXOutAct"] = same * i(np.diag(to)), diff * i(o - np.diag(to))
    f["homXOutAct"], f["homXOutAct2"] = to, to / j(C.sum(0))
    f["sameXReciAct"], f["diffXReciAct"], f["transTripX"] = i(np.diag(rec)), i(r - np.diag(rec)), j(v) * IS
    f["sameEgoDist2"], f["sameEgoInDist2"] = safe(to.T, j(o)), safe(fro.T - X, j(d) - X)
    f["sameXV"] = i(c) == j(p.zr)
    kinds = np.array([[(X * ((c == c[a])[:, None] & (p.zr == p.zr[b])[None, :])).sum() for b in range(n)] for a in range(n)])
    f["sameXVInPop"] = f["sameXVInPop2"] = (i(c) >= 1) * kinds
    # Dyadic covariate: centred as a weight of the tie, as it is in closures.
    f["X"], f["XRecip"] = Dc, X.T * Dc
    f["WWX"], f["cyWWX"], f["InWWX"], f["OutWWX"] = off(D @ D), off(D.T @ D.T), off(D.T @ D), off(D @ D.T)
    f["WXX"], f["XWX"], f["XXW"] = off(D @ X), off(X @ D), off(X.T @ D)
    f["XWX1"] = f["XWX2"] = f["XWX"]
    # Another network.
    WIS, WTP, WOS = off(W @ W.T), off(W @ W), off(W.T @ W)
    f["crprod"], f["crprod_gmm"], f["crprodRecip"], f["crprodMutual"] = W, W, W.T, WR
    f["inPopIntn"], f["inActIntn"], f["crprodInActIntn"], f["outPopIntn"], f["outActIntn"] = j(wd - p.adw), i(wd - p.adw), W * i(wd - p.adw), j(wo - p.adw), i(wo - p.adw)
    f["divOutEgoIntn"], f["divInEgoIntn"], f["divOutAltIntn"], f["divInAltIntn"] = i(safe(1, wo)), i(safe(1, wd)), j(safe(1, wo)), j(safe(1, wd))
    f["absOutDiffIntn"], f["avDegIntn"], f["both"] = abs(j(wo) - i(wo)), one * (W.sum() / n - P), i(wd - p.adw) * j(wd - p.adw)
    f["doubleOutAct"], f["doubleInPop"] = W * i((X * W).sum(1)), W * j((X * W).sum(0))
    f["outOutActIntn"], f["outOutAvIntn"], f["dist2OutInActIntn"], f["inPopOutW"] = i(W @ o), i(safe(W @ o, wo)), i(W @ wd), j(X.T @ wo)
    f["inPopIntnX"], f["inActIntnX"], f["outPopIntnX"], f["outActIntnX"] = j(W.T @ v), i(W.T @ v), j(W @ v), i(W @ v)
    f["sameXInPopIntn"], f["sameXInActIntn"] = (W.T @ C).T, i(np.diag(W.T @ C))
    f["sameXOutPopIntn"], f["sameXOutActIntn"] = (W @ C).T, i(np.diag(W @ C))
    f["altDist2W"], f["totDist2W"] = j(safe(W @ v, wo)), j(W @ v)
    f["simDist2W"] = sim(i(safe(W @ v, wo)), j(safe(W @ v, wo)))
    f["altInDist2W"], f["totInDist2W"] = safe(j(W.T @ v) - W * i(v), j(wd) - W), j(W.T @ v) - W * i(v)
    for name, m in {
        "from": WIS, "from_gmm": WIS, "fromMutual": off(WR @ WR), "fromAny": WIS > 0, "to": off(W @ X), "to_gmm": off(W @ X), "toBack": off(W.T @ X), "toRecip": off(WR @ X),
        "cl.XWX": off(X @ W) + off(X @ W.T), "cl.XWX1": off(X @ W), "cl.XWX2": off(X @ W.T), "mixedInXW": off(X.T @ W), "closure": WTP, "cyClosure": off(W.T @ W.T), "sharedIn": WOS,
        "WWX.EE": off(WE @ WE), "WXX.FE": off(W @ E), "XWX.ER": off(E @ WR), "WWX.FR": off(W @ WR), "WXX.ER": off(WE @ R), "XWX.FE": off(X @ WE),
        "gwespFFMix": gw(WTP), "gwespFBMix": gw(WIS), "gwespMix": gw(WIS), "gwespBFMix": gw(WOS), "gwespBBMix": gw(off(W.T @ W.T)), "gwespRRMix": gw(off(WR @ WR)),
        "JinMix": safe(WOS, i(wd) + j(wd) - WOS), "JoutMix": safe(WIS, i(wo) + j(wo) - WIS),
    }.items():
        f[name] = m
    con, every, ends = (lambda a, h, b: a == b != h), (lambda a, h, b: a != b and a != h and b != h), (lambda a, h, b: a == b)
    near, far = (lambda a, h, b: a == h), (lambda a, h, b: a != h)
    for name, A, B, ok in (
        ("covNetNet", W, W.T, ends), ("homCovNetNet", W, W.T, hom), ("jumpFrom", W, W.T, jump), ("contrastCovNetNet", W, W.T, con), ("allDifCovNetNet", W, W.T, every),
        ("sameWWClosure", W, W, near), ("diffWWClosure", W, W, far), ("jumpWWClosure", W, W, jump),
        ("jumpSharedIn", W.T, W, jump), ("covNetNetIn", W.T, W, ends), ("homCovNetNetIn", W.T, W, hom), ("contrastCovNetNetIn", W.T, W, con), ("allDifCovNetNetIn", W.T, W, every),
        ("sameWXClosure", W, X, near), ("diffWXClosure", W, X, far), ("homWXClosure", W, X, hom), ("jumpWXClosure", W, X, jump), ("sameXWClosure", X, W, near), ("diffXWClosure", X, W, far),
    ):
        f[name] = steps(A, B, ok)
    f["betweenPop"] = j([sum(W[a, m] * W[m, b] * (1 - W[a, b]) for a in range(n) for b in range(n) if a != b) for m in range(n)])
    f["nDist2ActIntn"], f["outOutDist2ActIntn"], f["avAlt.2M.tot"] = i((WIS > 0).sum(1)), i(WIS @ o), i(safe(WIS @ o, WIS.sum(1)))
    WD = W * D
    f["toU"] = off(WD @ X)
    f["from.w.ind"] = off((W * S.sum(0)[None, :]) @ W.T)
    # Primary settings at the start.
    U = np.maximum(S, S.T)
    prim = off((U + U @ U) > 0)
    pd = prim.sum(1)
    f["primary"], f["nonPrimary"], f["nonPCompress"], f["primCompress"] = prim, prim - 1, prim - 1, -prim
    f["primDegAct"], f["primDegActSqrt"], f["primDegActLog"], f["primDegActInv"] = i(pd), i(np.sqrt(pd)), i(np.log(pd + 1)), i(1 / (pd + 1))
    f["primDegActDiff"], f["primDegActDiffSqrt"] = i(pd - S.sum(1)), i(np.sqrt(pd - S.sum(1)))
    over = X if over is None else over
    return {name: float((over * np.asarray(m, float)).sum()) for name, m in f.items()}


def actor_effects(p):
    """name -> sum over actors."""
    X, S, W, D, v, c, n, z, z1, zr, zr1 = p.X, p.S, p.W, p.D, p.v, p.c, p.n, p.z, p.z1, p.zr, p.zr1
    o, d = X.sum(1), X.sum(0)
    g = {}
    g["outAct"], g["outAct.c"], g["outActSqrt"], g["avDeg"] = o * o, o * (o - p.adx), o**1.5, o * (X.sum() / n - P)
    g["outTrunc"], g["outTrunc2"] = np.minimum(o, P), np.minimum(o, P + 1)
    g["outMore"], g["outMore2"], g["outMore3"] = (np.maximum(o - P - k, 0) for k in range(3))
    g["outIso"], g["outThreshold"], g["outThreshold2"], g["outInv"], g["outSqInv"] = o == 0, o > P, o > P + 1, 1 / (o + 1), 1 / ((o + 1) * (o + 2))
    g["isolateNet"], g["antiIso"], g["antiInIso"], g["antiInIso2"], g["in2Plus"], g["in3Plus"] = (o == 0) & (d == 0), (d >= 1) & (o == 0), d >= 1, d >= 2, d >= 2, d >= 3
    g["outXMore"] = np.maximum(X @ (v > 0) - 1, 0)
    fl = np.floor(v)
    g["degAbsDiffX"], g["degPosDiffX"], g["degNegDiffX"] = abs(o - fl), np.maximum(o - fl, 0), np.maximum(fl - o, 0)
    own = np.array([sum(X[a, b] for b in range(n) if c[b] == c[a]) for a in range(n)])
    g["crossXOutAct"] = own * (o - own)
    g["avGroupEgoX"], g["totGroupEgoX"] = o * z.mean(), o * z.sum()
    gw = lambda k: np.exp(ALPHA) * (1 - (1 - np.exp(-ALPHA)) ** k)
    TP, IS, OS, WIS = off(X @ X), off(X @ X.T), off(X.T @ X), off(W @ W.T)
    g["gwdspFF"], g["gwdspFB"] = gw(TP).sum(1), gw(IS).sum(1)
    two = off(TP > 0) * (1 - X)
    g["nbrDist2"], g["nbrDist2twice"], g["IndTies"] = two.sum(1), (off(TP > 1) * (1 - X)).sum(1), two @ v
    cycles = lambda ok: sum(X[a, h] * X[k, h] * X[k, b] * X[a, b] for a in range(n) for k in range(n) for h in range(n) for b in range(n) if a != k and h != b and ok(a, k, h, b)) / 4
    g["cycle4"] = g["sharedPop"] = cycles(lambda a, k, h, b: True)
    g["sameXCycle4"], g["sameInXCycle4"] = cycles(lambda a, k, h, b: c[a] == c[k]), cycles(lambda a, k, h, b: c[h] == c[b])
    g["toAny"] = ((IS > 0) * W).sum(1)
    WDIS = off((W * D) @ (W * D).T)
    g["sharedTo"], g["sharedToU"] = (IS * WIS).sum(1), (IS * WDIS).sum(1)
    g["avAlt.2M.tie"], g["avAltU.2M.tie"] = safe((IS * WIS).sum(1), WIS.sum(1)), safe((IS * WDIS).sum(1), WDIS.sum(1))
    U = np.maximum(S, S.T)
    pd = off((U + U @ U) > 0).sum(1)
    for name in ("settingSizeAct", "settingSizeActSqrt", "settingSizeActLog", "settingOppAct", "settingOppActSqrt", "settingOppActLog", "settingLogCreationAct"):
        g[name] = pd
    g["settingSizeActInv"] = np.where(pd > 0, 1 / (pd + 1), 0)
    for name in ("settingOppActD", "settingOppActSqrtD", "settingOppActLogD", "settingLogCreationActD"):
        g[name] = np.maximum(pd - o, 0)
    # Behaviour: the network at the start, the behaviour at the end.
    so, si, SR = S.sum(1), S.sum(0), S * S.T
    sr = SR.sum(1)
    zs = p.sim(z1[:, None], z1[None, :], p.zrange, p.zsim)
    up, down = 1 - np.maximum(z1[None, :] - z1[:, None], 0) / p.zrange, 1 - np.maximum(z1[:, None] - z1[None, :], 0) / p.zrange
    g["linear"], g["intercept"], g["quad"], g["quad_nc"], g["constant"] = z1, z1, z1**2, zr1**2, -abs(zr1 - zr)
    g["threshold"], g["threshold2"], g["threshold3"], g["threshold4"] = zr1 >= ZP, zr1 >= ZP - 1, zr1 >= ZP + 1, zr1 >= ZP + 2
    g["feedback"], g["wiener"], g["effFrom"] = z1 * z, (z1 - z) ** 2, z1 * v
    g["indeg"], g["indegSqrt"], g["outdeg"], g["outdegSqrt"] = z1 * si, z1 * np.sqrt(si), z1 * so, z1 * np.sqrt(so)
    g["outInBalance"], g["isolate"], g["outIsolate"], g["isolateOut"] = z1 * safe(so - si, so + si), z1 * (si == 0), z1 * (so == 0), z1 * (so == 0)
    g["recipDeg"], g["nonrecipDeg"] = z1 * sr, z1 * (so - sr)
    g["degAbsContrX"], g["degPosContrX"], g["degNegContrX"] = z1 * abs(so - v), z1 * np.maximum(so - v, 0), z1 * np.maximum(v - so, 0)
    WR = W * W.T
    for name, A, B in (("FF", S, W), ("FB", S, W.T), ("BF", S.T, W), ("BB", S.T, W.T), ("FR", S, WR), ("BR", S.T, WR)):
        g[f"{name}Deg"] = z1 * (A * B).sum(1)
    g["indegMixedPop"], g["outdegMixedPop"] = z1 * (S.T @ W.sum(0)), z1 * (S @ W.sum(0))
    for name, A, M, weight in (
        ("Sim", S, zs, 1), ("InSim", S.T, zs, 1), ("SimRecip", SR, zs, 1), ("AttHigher", S, up, 1), ("AttLower", S, down, 1), ("SimPopAlt", S, zs, si[None, :]), ("InSimPopAlt", S.T, zs, si[None, :]), ("SimRecPop", SR, zs, si[None, :]),
        ("SimEgoX", S, zs, v[:, None]), ("SimAltX", S, zs, v[None, :]), ("SimW", S, zs, p.Dc), ("Alt", S, z1[None, :] * z1[:, None], 1), ("InAlt", S.T, z1[None, :] * z1[:, None], 1), ("RecAlt", SR, z1[None, :] * z1[:, None], 1),
        ("AltPop", S, z1[:, None] * (z1 * si)[None, :], 1), ("AltAltX", S, z1[:, None] * (z1 * v)[None, :], 1), ("XAlt", S, z1[:, None] * v[None, :], 1), ("XInAlt", S.T, z1[:, None] * v[None, :], 1), ("XRecAlt", SR, z1[:, None] * v[None, :], 1),
        ("AltEgoX", S, (v * z1)[:, None] * z1[None, :], 1), ("WAlt", S, z1[:, None] * p.Dc, 1), ("WInAlt", S.T, z1[:, None] * p.Dc.T, 1), ("AltW", S, z1[:, None] * p.Dc * z1[None, :], 1), ("InAltW", S.T, z1[:, None] * p.Dc.T * z1[None, :], 1),
    ):
        total = (A * M * weight).sum(1)
        g[f"tot{name}"], g[f"av{name}"] = total, safe(total, A.sum(1))
    for name in ("avAlt", "totAlt", "avSim"):
        g[f"{name}_gmm"] = g[name]
    g["popAlt"], g["totPopAlt"] = z1 * safe(S @ si, so), z1 * (S @ si)
    C = (c[:, None] == c[None, :]).astype(float)
    for name, A in (("Alt", S), ("RecAlt", SR)):
        g[f"tot{name}SameX"], g[f"av{name}SameX"] = z1 * ((A * C) @ z1), z1 * safe((A * C) @ z1, (A * C).sum(1))
    for name, A in (("Alt", S), ("InAlt", S.T), ("RecAlt", SR)):
        g[f"totSameX{name}"], g[f"avSameX{name}"] = z1 * (A * C).sum(1), z1 * safe((A * C).sum(1), A.sum(1))
    pick = lambda how, x: np.array([how(x[S[a] > 0]) if so[a] else 0 for a in range(n)])
    g["maxAlt"], g["minAlt"], g["maxXAlt"], g["minXAlt"] = z1 * pick(np.max, z1), z1 * pick(np.min, z1), z1 * pick(np.max, v), z1 * pick(np.min, v)
    g["maxAlt_gmm"], g["minAlt_gmm"] = g["maxAlt"], g["minAlt"]
    g["avSimPopEgo"] = si * g["avSim"]
    g["avSimVarAlt"] = g["avSim"] * pick(np.var, z1)
    g["varAlt"] = np.where(so > 0, z1 * (pick(np.var, z1) - p.zvar), 0)
    for name, A, B in (("FF", S, S), ("FB", S, S.T)):
        k = gw(off(A @ B))
        g[f"totGwdsp{name}Alt"], g[f"totGwdsp{name}Alt_nc"] = z1 * (k @ z1), zr1 * (k @ zr1)
    for name, A, x, ego, suffix in (("Alt", S, z1, z1, ""), ("InAlt", S.T, z1, z1, ""), ("InAlt", S.T, zr1, zr1, "_nc"), ("XAlt", S, v, z1, ""), ("XInAlt", S.T, v, z1, "")):
        total, mean = np.zeros((n, n)), np.zeros((n, n))
        for a in range(n):
            for b in range(n):
                others = [x[h] for h in range(n) if h != a and A[b, h]]
                total[a, b], mean[a, b] = sum(others), np.mean(others) if others else 0
        for short, m, averaged in (("av", mean, True), ("tot", total, False), ("avT", total, True), ("totA", mean, False)):
            s = (S * m).sum(1)
            g[f"{short}{name}Dist2{suffix}"] = ego * (safe(s, so) if averaged else s)
    m1 = z1.mean()
    g["quad_cc"], g["totAlt_cc"] = (z1 - m1) ** 2, (z1 - m1) * (S @ (z1 - m1))
    g["avAlt_cc"] = safe(g["totAlt_cc"], so)
    g["avGroup"], g["totGroup"], g["indegAvGroup"], g["indegTotGroup"] = z1 * m1, z1 * z1.sum(), z1 * (z1 @ si) / max(1, si.sum()), z1 * (z1 @ si)
    gap = abs(z1[:, None] - z1[None, :])
    g["simAllNear"], g["simAllFar"] = off((2 - gap) * (gap < 2)).sum(1), off((2 - gap) * (gap > 2)).sum(1)
    triads = [[(b, h) for b in range(n) for h in range(b) if SR[a, b] and SR[a, h] and SR[b, h]] for a in range(n)]
    g["behDenseTriads"] = z1 * [len(t) for t in triads]
    g["simDenseTriads"] = [sum(zs[a, b] + zs[a, h] for b, h in t) for a, t in enumerate(triads)]
    into = np.array([[(lambda o: p.sim(z1[a], np.mean(o), p.zrange, p.zsim) if o else 0)([z1[h] for h in range(n) if h != a and S[h, b]]) for b in range(n)] for a in range(n)])
    g["totInSimDist2"], g["avInSimDist2"] = (S * into).sum(1), safe((S * into).sum(1), so)
    # Rates of the behaviour: its steps, times what the actor has at the start.
    steps = abs(zr1 - zr)
    beyond = np.array([[sum(zr[h] for h in range(n) if h != a and S[h, b]) for b in range(n)] for a in range(n)])
    others = si[None, :] - S
    for name, s in {
        "behRate": 1, "behRateX": v, "behOutRate": so, "behInRate": si, "behRecipRate": sr, "avExposure": safe(S @ zr, so), "totExposure": S @ zr, "infectIn": S @ (zr * si), "infectDeg": S @ (zr * so), "infectOut": S @ (zr * so), "infectCovar": S @ (zr * v),
        "susceptAvIn": safe(S @ zr, so) * si, "susceptAvCovar": safe(S @ zr, so) * v, "totInExposureDist2": (S * beyond).sum(1), "avTinExposureDist2": safe((S * beyond).sum(1), so), "totAInExposureDist2": (S * safe(beyond, others)).sum(1), "anyInExposureDist2": (S * np.minimum(beyond, 1)).sum(1),
    }.items():
        g[name] = steps * s
    changes = abs(X - S).sum(1)
    for name, s in {"Rate": 1, "RateX": v, "RateZ": z, "outRate": so, "inRate": si, "recipRate": sr, "outRateInv": 1 / (so + 1), "inRateInv": 1 / (si + 1), "recipRateInv": 1 / (sr + 1), "outRateLog": np.log(so + 1), "inRateLog": np.log(si + 1), "recipRateLog": np.log(sr + 1)}.items():
        g[name] = changes * s
    g["settingRate"] = (abs(X - S) * off((U + U @ U) > 0)).sum()
    return {name: float(np.sum(x)) for name, x in g.items()}


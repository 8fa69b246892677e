"""Sequential account used as the yardstick for set-based accounting."""


def account(opens, closes, decisions, costs, cash=100_000.0, periods=252.0, cap=1.0):
    """Walk through the bars one by one.

    ``opens`` and ``closes`` map symbols to lists with None for gaps; ``decisions``
    maps a bar to ``{symbol: weight}``. Returns equity, cash and fills per bar.
    """
    n = len(next(iter(opens.values())))
    held = {s: 0.0 for s in opens}
    known, equity, cashes, fills, pending = {}, [], [], [], None
    for i in range(n):
        if pending is not None:
            price = {s: opens[s][i] if opens[s][i] is not None else known.get(s) for s in held}
            total = cash + sum(q * price[s] for s, q in held.items() if price[s] is not None)
            for s in held:
                # Without equity the rebalance is skipped, without a price above zero the symbol.
                if total <= 0 or price[s] is None or price[s] <= 0:
                    continue
                q = pending.get(s, 0.0) * total / price[s] - held[s]
                if abs(q * price[s]) < 1e-7:
                    continue
                paid = price[s] * (1 + (1 if q > 0 else -1) * costs.slippage_bps / 1e4)
                fee = abs(q) * costs.commission_per_share + abs(q * paid) * costs.commission_bps / 1e4
                held[s] += q
                cash -= q * paid + fee
                fills.append((i, s, q, paid, fee))
            pending = None
        dt = 1 / periods
        interest = cash * (costs.cash_rate if cash > 0 else costs.borrow_rate) * dt
        short = sum(-q * known.get(s, 0.0) for s, q in held.items() if q < 0)
        cash += interest - short * costs.borrow_rate * dt
        for s in held:
            if closes[s][i] is not None:
                known[s] = closes[s][i]
        equity.append(cash + sum(q * known.get(s, 0.0) for s, q in held.items()))
        cashes.append(cash)
        if i < n - 1 and i in decisions:
            w = decisions[i]
            gross = sum(abs(x) for x in w.values())
            pending = {s: x * (cap / gross if cap > 0 and gross > cap else 1) for s, x in w.items()}
    return equity, cashes, fills

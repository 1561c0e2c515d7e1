"""Squads of fifteen: who counts after substitutions and the captain's fallback, and the best plans of a few transfers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .players import BOUNDS

#: States of a squad at each depth that the first search goes on from, players of one club at most, plans returned of a depth. Fixed values.
BEAM, CLUB, PLANS = 140, 3, 24
#: Players of a position that the first search buys from; all, where these give too few plans.
FEW = 24
#: States taken one move further at once; what rounding may take from a gain.
BLOCK, SLACK = 2048, 1e-5
#: Of states: teams (a row of places in the players' arrays each), banks, gains, and moves (sold and bought places in turn).
State = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def appeared(minutes: Column, yellow: Column, red: Column) -> Column:
    """Minutes on the pitch, or a card without any."""
    return (minutes >= 1) | (yellow > 0) | (red > 0)


def resolved_lineups(squads: DataFrame, key: str) -> DataFrame:
    """One row a squad: counted (ids), subs (out_id, in_id in order), captain, multiplier, vice_used, total.

    squads: key, player_id, position, starts, place (order in the eleven, then of the bench, the keeper first), played,
    points, role (captain, vice, or null), chip (null, bench_boost, triple_captain; one for all rows of a squad). Of
    the bench those who played are tried in order, each for the first starter who did not play whose place it may take with
    the formation still legal; one who fits nowhere stays out. The captain's points count twice (three times under the
    chip); the vice takes over only if the captain did not appear and the vice did. With the bench boosted all count.
    A squad's fifteen rows are folded in its own row; an empty table gives an empty result.
    """
    player = F.struct("place", "player_id", "position", "played", "points")
    chosen = lambda role: F.max(F.when(F.col("role") == role, F.struct("player_id", "played"))).alias(f"_{role}")
    rows = squads.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("starts"), player))).alias("eleven"), F.array_sort(F.collect_list(F.when(~F.col("starts"), player))).alias("bench"), chosen("captain"), chosen("vice"), F.max("chip").alias("chip"))
    of = lambda team, p: F.size(F.filter(team, lambda x: x["position"] == p))

    def fold(state: Column, new: Column) -> Column:
        team = state["team"]
        counts = {p: of(team, p) for p in BOUNDS}

        def fits(x: Column) -> Column:
            ok = ~x["played"]
            for p, (low, high) in BOUNDS.items():
                after = counts[p] + (new["position"] == p).cast("int") - (x["position"] == p).cast("int")
                ok = ok & after.between(low, high)
            return ok

        at = F.array_min(F.filter(F.transform(team, lambda x, i: F.when(fits(x), i)), lambda i: i.isNotNull()))
        swapped = F.transform(team, lambda x, i: F.when(i == at, new).otherwise(x))
        subs = F.concat(state["subs"], F.array(F.struct(F.get(team, at)["player_id"].alias("out_id"), new["player_id"].alias("in_id"))))
        return F.when(at.isNull(), state).otherwise(F.struct(swapped.alias("team"), subs.alias("subs")))

    boosted = F.coalesce(F.col("chip") == "bench_boost", F.lit(False))
    none = F.array().cast("array<struct<out_id: bigint, in_id: bigint>>")
    ready = F.when(boosted, F.slice("bench", 1, 0)).otherwise(F.filter("bench", lambda x: x["played"]))
    team = F.when(boosted, F.concat("eleven", "bench")).otherwise(F.col("eleven"))
    rows = rows.withColumn("done", F.aggregate(ready, F.struct(team.alias("team"), none.alias("subs")), fold))
    vice = F.coalesce(~F.col("_captain.played") & F.col("_vice.played"), F.lit(False))
    armband = F.when(vice, F.col("_vice.player_id")).otherwise(F.col("_captain.player_id"))
    times = F.when(F.col("chip") == "triple_captain", 3).otherwise(2)
    total = F.aggregate("done.team", F.lit(0).cast("long"), lambda a, x: a + x["points"] * F.when(x["player_id"] == armband, times).otherwise(1))
    return rows.select(key, F.col("done.team.player_id").alias("counted"), "done.subs", armband.alias("captain"), times.alias("multiplier"), vice.alias("vice_used"), total.alias("total"))


def pools(market: DataFrame, league: str) -> DataFrame:
    """(league, pool): all of each league's players (player_id, position, team_id, price, xp)."""
    return market.groupBy(league).agg(F.array_sort(F.collect_list(F.struct("player_id", "position", "team_id", "price", "xp"))).alias("pool"))


@dataclass
class Search:
    """One squad's moves. position, club, price, xp: of all its players and its market, by id; team: the squad's places in them.

    A move is worth what it gains and, at `money` a tenth, what it frees. A plan ends with no debt, so its gain is at most the
    worth of its moves and of the bank: what a state can still come to is bounded by the best moves of the players it has left.
    """

    position: np.ndarray
    club: np.ndarray
    price: np.ndarray
    xp: np.ndarray
    team: np.ndarray

    def __post_init__(self) -> None:
        known = (self.position >= 0) & ~np.isnan(self.price) & ~np.isnan(self.xp)
        buys = known & (self.club >= 0)
        buys[self.team] = False
        self.sold = self.team[known[self.team]]
        self.of = {p: np.flatnonzero(buys & (self.position == p)) for p in np.unique(self.position[self.sold])}

    def worth(self, money: float) -> tuple[np.ndarray, np.ndarray]:
        """Each player's worth, and what the best move of each of the squad's is worth; minus infinity for who has none."""
        worth, best = self.xp - money * self.price, np.full(len(self.xp), -np.inf)
        top = {p: worth[new].max(initial=-np.inf) for p, new in self.of.items()}
        best[self.sold] = [top[p] for p in self.position[self.sold]] - worth[self.sold]
        return worth, best

    def tightest(self, bank: float, depth: int) -> float:
        """What a tenth is worth so that the bound on a plan of so many moves is least; any other would do as well, with more states."""
        bound = lambda money: money * bank + np.sort(self.worth(money)[1][self.team])[-depth:].sum()
        low, high = 0.0, float(np.nan_to_num(np.nanmax(self.xp) - np.nanmin(self.xp)))
        for _ in range(30):  # the bound is convex
            a, b = low + (high - low) / 3, high - (high - low) / 3
            low, high = (low, b) if bound(a) <= bound(b) else (a, high)
        return (low + high) / 2

    def after(self, state: State, money: float, left: int, floor: float, beam: int | None = None, few: int | None = None) -> State:
        """The states one move after these that can reach a gain of `floor` with `left` more moves, or of these the `beam` best that buy one of the `few` of most worth; by gain, bank and ids, equal squads once."""
        worth, best = self.worth(money)
        ranked = {p: new[np.argsort(-worth[new], kind="stable")][:few] for p, new in self.of.items()}
        parts = [self._moves(tuple(x[at : at + BLOCK] for x in state), money, worth, best, ranked, left, floor, at) for at in range(0, max(len(state[0]), 1), BLOCK)]
        at, slot, new, gain, cash = map(np.concatenate, zip(*parts))
        teams, _, _, moves = state
        if beam is not None:
            most = beam * (moves.shape[1] // 2 + 1) ** 2  # a squad is reached by at most depth^2 last moves, all of its own gain and bank
            if len(gain) > most:
                good = gain >= np.partition(gain, len(gain) - most)[len(gain) - most]
                at, slot, new, gain, cash = at[good], slot[good], new[good], gain[good], cash[good]
            first = np.lexsort((new, teams[at, slot], at, -cash, -gain))[:most]
            at, slot, new, gain, cash = at[first], slot[first], new[first], gain[first], cash[first]
        after = teams[at]
        path = np.column_stack([moves[at], after[np.arange(len(at)), slot], new])
        after[np.arange(len(at)), slot] = new
        after.sort(1)  # places go by id
        # equal squads next to each other, the least path first; gain and bank are the squad's own
        order = np.lexsort((*path.T[::-1], *after.T[::-1]))
        single = np.ones(len(order), bool)
        single[1:] = (after[order[1:]] != after[order[:-1]]).any(1)
        starts, kept = np.flatnonzero(single), order[single]
        if len(kept):
            gain, cash = np.maximum.reduceat(gain[order], starts), np.maximum.reduceat(cash[order], starts)
        ends = np.lexsort((*after[kept].T[::-1], -cash, -gain))[:beam]
        return after[kept[ends]], cash[ends], gain[ends], path[kept[ends]]

    def _moves(self, state: State, money: float, worth: np.ndarray, best: np.ndarray, ranked: dict, left: int, floor: float, start: int) -> tuple[np.ndarray, ...]:
        """State (counted from `start`), slot, player bought, gain and bank of each move that is allowed and may reach the floor."""
        teams, bank, delta, moves = state
        stays = (teams[:, :, None] == moves[:, None, 1::2]).any(2)
        ahead = np.where(stays, -np.inf, best[teams])
        top = -np.sort(-ahead, 1)[:, : left + 1]
        able = np.isfinite(ahead) & np.isfinite(top[:, -1:]) & (top.shape[1] > left)
        with np.errstate(invalid="ignore"):
            others = 0.0 if not left else np.where(ahead >= top[:, left - 1 : left], top.sum(1)[:, None] - ahead, top[:, :left].sum(1)[:, None])  # the best moves of the rest
            need = floor - SLACK - (delta + money * bank)[:, None] - others + worth[teams]
        owned = np.zeros((len(teams), len(self.xp)), bool)  # now, or sold before
        states = np.arange(len(teams))[:, None]
        owned[states, teams] = owned[states, moves[:, 0::2]] = True
        held = np.zeros((len(teams), self.club.max() + 2), np.int64)
        np.add.at(held, (states, self.club[teams]), 1)
        parts = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0),) * 2]
        for p, buys in ranked.items():  # the best first, as far as any may do
            at, slot = np.nonzero(able & (self.position[teams] == p))
            count = np.searchsorted(-worth[buys], -need[at, slot], side="right")
            at, slot = np.repeat(at, count), np.repeat(slot, count)
            new, old = buys[np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)], teams[at, slot]
            gain, cash = np.round(delta[at] + self.xp[new] - self.xp[old], 6), bank[at] + self.price[old] - self.price[new]
            fits = (cash >= 0) & (gain > 0) & ~owned[at, new] & ((self.club[new] == self.club[old]) | (held[at, self.club[new]] < CLUB))
            parts.append((at[fits] + start, slot[fits], new[fits], gain[fits], cash[fits]))
        return tuple(map(np.concatenate, zip(*parts)))

    def plans(self, bank: float, depths: int, beam: int) -> Iterator[tuple[int, State]]:
        """(depth, the PLANS best of all plans of so many moves). The `beam` best states a depth give plans, and so a floor; then every state that can reach the floor is followed."""
        start: State = (self.team[None, :], np.array([bank]), np.zeros(1), np.zeros((1, 0), np.int64))
        for depth in range(min(2, depths), depths + 1):
            money, floor = self.tightest(bank, depth), -np.inf
            for few in (FEW, len(self.xp)):
                found = start
                for _ in range(depth):
                    found = self.after(found, money, 0, -np.inf, beam, few)
                if len(found[2]) >= PLANS:
                    floor = found[2][PLANS - 1]
                    break
            state = start
            for left in range(depth - 1, -1, -1):
                state = self.after(state, money, left, floor)
            if not len(state[0]):
                break
            yield depth, tuple(x[:PLANS] for x in state)


def _flat(lists: pa.Array) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Offsets and fields of a column of lists of players."""
    rows = lists.flatten()
    return np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int64), {f.name: rows.field(i) for i, f in enumerate(rows.type)}


def _codes(*parts: pa.Array) -> list[np.ndarray]:
    """Equal values of all parts as equal whole numbers; null: -1."""
    found = pa.concat_arrays(parts).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(found, np.cumsum([len(p) for p in parts])[:-1])


def transfer_plans(squads: DataFrame, market: DataFrame, banks: DataFrame, key: str, league: str, depths: int = 3, beam: int = BEAM) -> DataFrame:
    """(key, depth, rank, delta, bank, moves): the PLANS best plans of each squad at each depth from 2 on (1 if depths is 1).

    squads: key, league, player_id, position, team_id, price (whole tenths), xp. market: the same of all players.
    banks: key, bank. A move sells one of the squad for one of the market of the same position that the bank affords,
    not owned, not sold before, and no more than CLUB of its club; who was bought is not sold, and every move leaves a gain.
    Plans go by gain, then bank; squads that are equal whatever the order of the moves are merged by their sorted ids.
    They are the best of all plans on the league's whole market: `beam` states a depth only give a first bound, and a
    state is left only if it cannot come to the plans returned. A squad's row comes with its league's pool, and its
    states never leave the task: what is shuffled is a row a squad, whatever the depth.
    """
    player = F.struct("player_id", "position", "team_id", "price", "xp")
    start = squads.groupBy(key, league).agg(F.array_sort(F.collect_list(player)).alias("_squad")).join(banks.select(key, "bank"), key)
    rows = start.join(pools(market, league), league).select(key, "_squad", "pool", F.col("bank").cast("double").alias("bank"))
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(key))  # small rows with much work each; by key itself a join's own partitions, drawn together, would do
    link = pa.struct([("out_id", pa.int64()), ("in_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            ends, fields = zip(*map(_flat, (batch.column(1), batch.column(2))))
            ids = [f["player_id"].to_numpy(zero_copy_only=False) for f in fields]
            exact = [[f[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for f in fields] for c in ("price", "xp")]
            named = [_codes(*[f[c] for f in fields]) for c in ("position", "team_id")]
            got = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), *np.zeros((2, 0)), np.zeros((0, 2), np.int64))]
            for i, bank in enumerate(batch.column(3).to_numpy(zero_copy_only=False)):
                own, listed = (slice(e[i], e[i + 1]) for e in ends)
                spare = np.flatnonzero(~np.isin(ids[1][listed], ids[0][own])) + listed.start  # who is owned or was sold is not bought
                who = np.concatenate([ids[0][own], ids[1][spare]])
                order = np.argsort(who, kind="stable")
                table = [np.concatenate([x[own], y[spare]])[order] for x, y in (*named, *exact)]
                team = np.sort(np.argsort(order, kind="stable")[: own.stop - own.start])
                who = who[order]
                for depth, state in Search(*table, team).plans(bank, depths, beam):
                    n = len(state[0])
                    got.append((np.full(n, i), np.arange(1, n + 1), np.full(n, depth, np.int32), state[2], state[1], who[state[3]].reshape(-1, 2)))
            whose, rank, depth, delta, bank, moves = map(np.concatenate, zip(*got))
            paths = pa.StructArray.from_arrays([pa.array(moves[:, 0], pa.int64()), pa.array(moves[:, 1], pa.int64())], fields=list(link))
            offsets = np.concatenate(([0], np.cumsum(depth))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(whose)), pa.array(depth), pa.array(rank), pa.array(delta), pa.array(bank.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), paths)], [key, "depth", "rank", "delta", "bank", "moves"])

    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, depth int, rank long, delta double, bank long, moves array<struct<out_id: bigint, in_id: bigint>>")

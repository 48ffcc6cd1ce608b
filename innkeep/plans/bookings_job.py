"""``ingest_bookings``: the one order-dependent job.

A booking request claims rooms of one hotel.  Applied one at a time in
``request_seq`` order, a request is accepted only if every room exists in its
hotel and is available; accepting it makes those rooms unavailable for the
later requests.  A rejected request claims nothing.

Plan:

1. Static checks by joins (validation, hotel, capacity, customer, each item:
   room exists, stored flag available, not already named earlier in the same
   request).  Requests passing them are *candidates*.
2. Claims between candidates are settled in rounds.  In a round every pending
   request that is the earliest pending claimant of *all* its rooms is
   accepted; pending requests that touch a room just taken are rejected.  The
   earliest pending request of every hotel is accepted each round and a
   room is taken at most once per batch, so the number of rounds is at most
   the largest hotel's room count + 1, however many requests arrive (and in
   practice a few: all non-conflicting requests settle in round one).  Each
   round is a partial aggregate (min per room) and joins, with no group
   collected in one place; its decisions are checkpointed to the shared
   checkpoint folder, which cuts the lineage and survives executor loss.
3. The reported item of a rejected request is its first item (by position)
   that is missing, unavailable, repeated, or claimed by an earlier accepted
   request.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from innkeep.plans import validation as V
from innkeep.plans.jobs import (MSG, JobResult, Outputs, assign_ids, first_failure, flag, last_number,
                                room_booked, room_not_found)
from innkeep.functions.rules import parse_date
from innkeep.session import checkpoint_dir, materialize
from innkeep.sources.commands import sanitized


def settle_claims(claims: DataFrame) -> DataFrame:
    """(request_seq) of the accepted requests among ``claims``
    (request_seq, hotel_id, room_number), applying them in request order.

    Each round materialises one small decision table (win / lose / open per
    pending request) with a reliable checkpoint; the next round's claims are
    ``claims`` semi-joined with the open requests, so the lineage never grows
    beyond one checkpoint."""
    spark = claims.sparkSession
    checkpoint_dir(spark)
    claims = claims.select("request_seq", "hotel_id", "room_number").checkpoint(eager=True)
    pending = claims
    won_parts = []
    rounds = 0
    while True:                              # the earliest open request is settled in every round
        rounds += 1
        first = pending.groupBy("hotel_id", "room_number").agg(F.min("request_seq").alias("_m"))
        per_req = (pending.join(first, ["hotel_id", "room_number"])
                   .groupBy("request_seq")
                   .agg(F.max((F.col("request_seq") != F.col("_m")).cast("int")).alias("_blocked")))
        winners = per_req.where(F.col("_blocked") == 0).select("request_seq")
        taken = pending.join(winners, "request_seq", "left_semi").select("hotel_id", "room_number")
        touching = (pending.join(taken, ["hotel_id", "room_number"], "left_semi")
                    .select("request_seq").distinct().withColumn("_touch", F.lit(1)))
        decision = (per_req.join(touching, "request_seq", "left")
                    .select("request_seq",
                            F.when(F.col("_blocked") == 0, F.lit("win"))
                            .when(F.col("_touch") == 1, F.lit("lose"))
                            .otherwise(F.lit("open")).alias("d"))
                    .checkpoint(eager=True))
        won_parts.append(decision.where(F.col("d") == "win").select("request_seq"))
        still_open = decision.where(F.col("d") == "open").select("request_seq")
        if still_open.isEmpty():
            break
        pending = claims.join(still_open, "request_seq", "left_semi")
    accepted = won_parts[0]
    for w in won_parts[1:]:
        accepted = accepted.unionByName(w)
    settle_claims.last_rounds = rounds
    return accepted


def _item_rows(fx, header: DataFrame) -> DataFrame:
    """Each item of each request with its errors and static state, computed once
    for all that reads it: the room row (first by id, as rooms[0]), its flag and
    price, and whether the number repeats within the request.  ``_n`` counts the
    request's items, ``_r`` numbers them.  The windows run over one request's
    items, on the partitioning by ``request_seq`` that the header joins too."""
    of_request, of_room = Window.partitionBy("request_seq"), Window.partitionBy("request_seq", "room_number")
    items = (sanitized(fx.booking_request_rooms()).where(F.col("request_seq").isNotNull())
             .withColumn("_r", F.row_number().over(of_request.orderBy("room_number", "pos")))
             .withColumn("_p0", F.min("pos").over(of_room))
             .withColumn("_n", F.count(F.lit(1)).over(of_request))
             .withColumn("_errors", V.spark_errors(V.BOOKING_ROOM)))
    rooms = fx.rooms().groupBy("hotel_id", "room_number").agg(
        F.min_by("is_available", "id").alias("_avail"), F.min_by("price_per_night", "id").alias("_price"),
        F.lit(True).alias("_found"))
    it = (items.join(header.select("request_seq", "hotel_id"), "request_seq")
          .join(rooms, ["hotel_id", "room_number"], "left")
          .withColumn("_found", F.coalesce("_found", F.lit(False)))
          .withColumn("_static_bad", ~F.col("_found") | ~F.coalesce("_avail", F.lit(False))
                      | F.coalesce(F.col("pos") > F.col("_p0"), F.lit(False))))
    return materialize(it.select("request_seq", "pos", "_r", "_n", "hotel_id", "room_number", "check_in", "check_out",
                                 "_found", "_price", "_static_bad",
                                 F.when(F.size("_errors") > 0, F.col("_errors")).alias("_errors")))


def _checked(fx, header: DataFrame, rows: DataFrame) -> DataFrame:
    """The header rows with their request's errors (header, then items in
    position order), item count ``_n`` and ``_bad`` (an item cannot be booked)."""
    empty = F.array().cast("array<string>")
    per = rows.groupBy("request_seq").agg(
        F.max("_n").alias("_n"), F.max(F.when(F.col("room_number").isNotNull(), F.col("_static_bad").cast("int"))).alias("_bad"))
    # a set: a repeated header repeats its items
    failing = (rows.where(F.col("_errors").isNotNull()).groupBy("request_seq")
               .agg(F.array_sort(F.collect_set(F.struct("pos", F.col("_errors").alias("e"), "_r"))).alias("_l"))
               .select("request_seq", F.flatten(F.transform("_l", lambda x: x["e"])).alias("_items")))
    none = F.when(F.col("_n").isNull(), F.array(F.lit(V.MSG_BOOKING_ROOMS_EMPTY))).otherwise(empty)
    of_header = header.select("request_seq", V.spark_errors(V.BOOKING).alias("_header"))
    return (header.join(of_header, "request_seq").join(per, "request_seq", "left").join(failing, "request_seq", "left")
            .withColumn("errors", F.concat("_header", F.coalesce("_items", empty), none)).drop("_header", "_items"))


def ingest_bookings(fx) -> JobResult:
    header = sanitized(fx.booking_requests())
    rows = _item_rows(fx, header)
    it = rows.where(F.col("room_number").isNotNull())
    v = _checked(fx, header, rows)
    hotels = fx.hotels().select("hotel_id", F.col("total_rooms").alias("_total_rooms"), F.lit(True).alias("_hotel"))
    v = v.join(hotels, "hotel_id", "left").withColumn("_hotel", F.coalesce("_hotel", F.lit(False)))
    v = flag(v, fx.customers(), ["customer_id"], "_cust")

    static = [(F.size("errors") == 0, "VALIDATION", F.array_join("errors", " | ")),
              (F.col("_hotel"), "HOTEL_NOT_FOUND", MSG["HOTEL_NOT_FOUND"]),
              (F.coalesce("_total_rooms", F.lit(0)) >= F.coalesce("_n", F.lit(0)), "NOT_ENOUGH_ROOMS",
               MSG["NOT_ENOUGH_ROOMS"]),
              (F.col("_cust"), "CUSTOMER_NOT_FOUND", MSG["CUSTOMER_NOT_FOUND"])]
    code, msg = first_failure(static)
    v = materialize(v.select("request_seq", "customer_id", "hotel_id", "total_amount", "booking_status", "_bad",
                             code.alias("_code"), msg.alias("_msg")))

    candidates = v.where((F.col("_code") == "OK") & (F.coalesce("_bad", F.lit(0)) == 0)).select("request_seq")
    claims = it.join(candidates, "request_seq", "left_semi").select("request_seq", "hotel_id", "room_number")
    accepted = settle_claims(claims)

    # who holds each room after the batch (accepted requests never share one)
    holder = (claims.join(accepted, "request_seq", "left_semi")
              .select("hotel_id", "room_number", F.col("request_seq").alias("_holder")))
    it2 = it.join(holder, ["hotel_id", "room_number"], "left").withColumn(
        "_item_bad", F.col("_static_bad") | F.coalesce(F.col("_holder") < F.col("request_seq"), F.lit(False)))
    first_bad = (it2.where(F.col("_item_bad")).groupBy("request_seq")
                 .agg(F.min_by(F.struct("room_number", "_found"), "pos").alias("_fb")))
    v = v.join(first_bad, "request_seq", "left").join(accepted.withColumn("_acc", F.lit(True)), "request_seq",
                                                     "left")
    item_msg = F.when(~F.col("_fb._found"), room_not_found(F.col("_fb.room_number"), F.col("hotel_id"))) \
        .otherwise(room_booked(F.col("_fb.room_number")))
    item_code = F.when(~F.col("_fb._found"), F.lit("ROOM_NOT_FOUND")).otherwise(F.lit("ROOM_UNAVAILABLE"))
    status = v.select(
        "request_seq",
        F.when(F.col("_code") != "OK", F.col("_code")).when(F.col("_acc"), F.lit("OK"))
        .otherwise(item_code).alias("code"),
        F.when(F.col("_code") != "OK", F.col("_msg")).when(F.col("_acc"), F.lit(None).cast("string"))
        .otherwise(item_msg).alias("message"))

    ok = v.where(F.col("_acc")).select("request_seq", "customer_id", "hotel_id", "total_amount",
                                       "booking_status")
    bookings = assign_ids(ok, ["request_seq"], "BOOK", last_number(fx.bookings(), "booking_id", 5), "booking_id")
    new_bookings = bookings.select("request_seq", "booking_id", "customer_id", "hotel_id",
                                   F.col("total_amount").cast("decimal(10,2)").alias("total_amount"),
                                   F.coalesce("booking_status", F.lit("Confirmed")).alias("booking_status"))
    status = status.join(new_bookings.select("request_seq", "booking_id"), "request_seq", "left")
    def rooms_snapshot():
        taken = holder.select("hotel_id", "room_number").distinct().withColumn("_t", F.lit(True))
        return (fx.rooms().join(taken, ["hotel_id", "room_number"], "left")
                .withColumn("is_available", F.when(F.col("_t"), F.lit(False)).otherwise(F.col("is_available")))
                .drop("_t"))
    return JobResult(status, Outputs(bookings=new_bookings,
                                     booking_rooms=lambda: _new_booking_rooms(fx, it, new_bookings),
                                     rooms_taken=holder.select("hotel_id", "room_number"),
                                     rooms=rooms_snapshot))


def _new_booking_rooms(fx, it: DataFrame, new_bookings: DataFrame) -> DataFrame:
    br_items = it.join(new_bookings.select("request_seq", "booking_id"), "request_seq")
    new_br = assign_ids(br_items, ["request_seq", "pos"], "BR",
                        last_number(fx.booking_rooms(), "booking_room_id", 3), "booking_room_id")
    return new_br.select("request_seq", "pos", "booking_room_id", "booking_id", "room_number",
                         parse_date(F.col("check_in")).alias("check_in"),
                         parse_date(F.col("check_out")).alias("check_out"),
                         # the room's price, NULL read as 0 (Number(null))
                         F.coalesce("_price", F.lit(0)).cast("decimal(10,2)").alias("room_amount"))

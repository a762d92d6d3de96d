"""Explicit schemas of stored races, requests and source payloads, as DDL text."""

from __future__ import annotations

LAP = "struct<time_ms:bigint,lap_number:int>"

WEATHER = (
    "struct<temperature:double,humidity:double,pressure:double,wind_speed:double,"
    "wind_direction:int,rainfall:boolean,track_temp:double>"
)

RESULT = (
    "struct<driver_id:string,constructor_id:string,grid_position:int,final_position:int,"
    f"points:double,fastest_lap:{LAP},status:string,laps_completed:int>"
)

QUALIFYING = (
    f"struct<driver_id:string,constructor_id:string,position:int,q1_time:{LAP},q2_time:{LAP},q3_time:{LAP}>"
)

STORED_RACE = (
    "season int, round int, race_id string, part long, first_result long, circuit_id string, race_name string, date string, "
    f"results array<{RESULT}>, qualifying array<{QUALIFYING}>, weather {WEATHER}, _corrupt_record string"
)

_PAYLOAD_TIME = "struct<Time:struct<time:string>>"
_PAYLOAD_RESULT = (
    "struct<Driver:struct<driverId:string>,Constructor:struct<constructorId:string>,grid:string,"
    f"position:string,points:string,status:string,laps:string,FastestLap:{_PAYLOAD_TIME}>"
)
_PAYLOAD_QUALIFYING = (
    "struct<Driver:struct<driverId:string>,Constructor:struct<constructorId:string>,position:string,"
    "Q1:string,Q2:string,Q3:string>"
)
_PAYLOAD_RACE = (
    "struct<season:string,round:string,raceName:string,date:string,time:string,"
    f"Circuit:struct<circuitId:string>,Results:array<{_PAYLOAD_RESULT}>,"
    f"QualifyingResults:array<{_PAYLOAD_QUALIFYING}>>"
)
RACE_PAYLOAD = (
    f"MRData struct<offset:string,RaceTable:struct<Races:array<{_PAYLOAD_RACE}>>>, _corrupt_record string"
)

_STANDING = "position:string,points:string,wins:string"
STANDINGS_PAYLOAD = (
    "MRData struct<StandingsTable:struct<season:string,StandingsLists:array<struct<season:string,round:string,"
    f"DriverStandings:array<struct<{_STANDING},Driver:struct<driverId:string>>>,"
    f"ConstructorStandings:array<struct<{_STANDING},Constructor:struct<constructorId:string>>>>>>>, "
    "_corrupt_record string"
)

REQUEST_DRIVERS = (
    "array<struct<driver_id:string,name:string,grid_position:int,fuel_load:double,"
    "tire_compound:int,engine_power:double>>"
)
REQUEST_WEATHER = (
    "struct<conditions:string,track_temp:double,air_temp:double,humidity:double,"
    "wind_speed:double,grip_level:double>"
)
REQUEST_CSV = ("race_name string, circuit string, date string, drivers string, weather string")

"""Statement texts of our own, one per layout and failure."""

CHECKING = """STANDARD BANK
Checking Account Number: *4411
Statement Period: 2024-03-01 to 2024-03-31

ACCOUNT SUMMARY
Starting Balance: $2,000.00
Deposits and Additions: $750.00
Withdrawals and Subtractions: $120.00
Interest Paid: $3.50
Fees Charged: $8.00
Ending Balance: $2,625.50

TRANSACTION DETAILS
Date    Description    Amount    Balance
2024-03-04    Payroll Deposit    +$750.00    $2,750.00
03/09/2024    ATM Withdrawal    -$120.00    $2,630.00
3/15/24    Monthly Service Fee    ($8.00)    $2,622.00
2024-03-31    Interest Earned    +$3.50    $2,625.50
END OF STATEMENT"""

SAVINGS = """STANDARD BANK
Savings Account Number: *4412
Statement Period: 03/01/2024 - 03/31/2024

ACCOUNT SUMMARY
Starting Balance: $900.00
Deposits and Additions: $0.00
Withdrawals and Subtractions: $0.00
Interest Paid: $1.25
Fees Charged: $0.00
Ending Balance: $901.25

TRANSACTION DETAILS
Date | Description | Amount | Balance
2024-03-31 | Interest Earned | +$1.25 | $901.25
END OF STATEMENT"""

CARD = """STANDARD CARD
Credit Card Statement
Card Number: *7788
Statement Period: 2024-03-01 to 2024-03-31
Payment Due Date: 2024-04-25
Minimum Payment Due: $35.00

ACCOUNT SUMMARY
Previous Balance: $640.00
Payments and Credits: $640.00
Purchases: $310.25
Cash Advances: $0.00
Balance Transfers: $0.00
Fees Charged: $25.00
Interest Charged: $4.75
New Balance: $340.00

TRANSACTIONS
Date    Description    Amount
2024-03-03    Payment Received    -$640.00
2024-03-10    Coffee Roaster Purchase    +$310.25
2024-03-15    Late Fee    +$25.00
2024-03-31    Interest Charge    +$4.75
END OF STATEMENT"""

BROKERAGE = """CHARLES SCHWAB
Individual Brokerage Account
Account Number: ****5566
Statement Period: 2024-03-01 to 2024-03-31

ACCOUNT SUMMARY
Starting Cash Balance: $5,000.00
Ending Cash Balance: $6,850.00

PORTFOLIO SUMMARY
Starting Portfolio Value: $20,000.00
Transfers In: $2,000.00
Transfers Out: $200.00
Income and Dividends: $90.00
Realized Gain/Loss: $300.00
Unrealized Gain/Loss: -$150.00
Ending Portfolio Value: $22,040.00

TRANSACTION ACTIVITY
Date    Description    Amount
2024-03-05    Wire In    +$2,000.00
2024-03-12    Funds Withdrawal    -$200.00
2024-03-20    Qualified Dividend    +$90.00
2024-03-25    Account Fee    -$40.00

POSITIONS
Symbol    Description    Quantity    Market Value
ABC    Alpha Beta Co    10    $1,200.00
XYZ    Xylo Zinc    2.5    $800.50
Holdings Total: $2,000.50
END OF STATEMENT"""

FUND = """VANGUARD
Vanguard Account: *3344
Registration: Brokerage Margin
Period: 2024-03-01 through 2024-03-31

CASH SUMMARY
Opening Cash: $1,000.00
Closing Cash: $1,475.00

ACTIVITY
Date | Activity | Amount
2024-03-04 | Transfer In | +$500.00
2024-03-18 | Buy Fund | -$50.00
2024-03-28 | Fund Dividend | +$25.00

FUND POSITIONS
Symbol | Description | Shares | Value
VTX | Total Index | 3.25 | $325.00
Positions Total: $325.00

PORTFOLIO BRIDGE
Opening Portfolio Value: $9,000.00
Transfers In: $500.00
Transfers Out: $0.00
Dividends: $25.00
Realized Gain: $0.00
Unrealized Gain: -$75.00
Closing Portfolio Value: $9,450.00"""

COMBINED = """STANDARD BANK
COMBINED ACCOUNT STATEMENT
Statement Period: 2024-03-01 to 2024-03-31
Combined Total Balance: $3,526.75

Checking Account Number: *4411
Checking Summary
Starting Balance: $2,000.00
Deposits: $750.00
Withdrawals: $120.00
Fees: $4.50
Ending Balance: $2,625.50

Savings Account Number: *4412
Savings Summary
Starting Balance: $900.00
Interest Paid: $1.25
Ending Balance: $901.25

CHECKING ACCOUNT SUMMARY
CHECKING TRANSACTION DETAILS
Date    Description    Amount    Balance
2024-03-04    Direct Pay    +$750.00    $2,750.00
2024-03-09    Cash Machine    -$120.00    $2,630.00
2024-03-15    Upkeep Fee    -$4.50    $2,625.50

SAVINGS ACCOUNT SUMMARY
SAVINGS TRANSACTION DETAILS
Date    Description    Amount    Balance
2024-03-31    Interest    +$1.25    $901.25

END OF STATEMENT"""
